"""Bounds and odd rows: null and repeated ids, long texts and hosts, empty tables."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import decontaminate, language_id, quality, token_files, url_filters


# -- 1 --
def test_pieces_of_random_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, fresh = token_files.Encoder(path, 2), Tokenizer.from_file(path)
    rnd = random.Random(1)
    alphabet = "ab  \n\n\t.,'\"(é1²日\x1c\x85\u00a0s\u2003\u3000\u1680àtZ9-\r"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + [None, "word " * 3000, "x" * 9000, "日本語" * 900]
    ids, begin = enc.encode_all(pa.array(texts))
    for k, e in enumerate(fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[begin[k] : begin[k + 1]].tolist() == [*e.ids, 2]
    assert enc.encode_all(pa.array([], pa.string()))[0].size == 0
    bare = token_files.Encoder(path, None)
    assert np.frombuffer(bare.encode("a <|endoftext|> b"), bare.dtype).tolist() == fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_cache_is_bounded():
    made = []
    cache = token_files._Cache(lambda k: made.append(k) or k, 10)
    for k in [*range(100), *range(95, 100)]:
        assert cache[k] == k and len(cache) <= 10 and len(cache.old) <= 10
    assert len(made) == 100


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths_are_the_best(seed):
    """Against all length vectors that a prefix code of few ids can have."""
    rnd = random.Random(seed)
    counts = np.array([rnd.choice([0, 1, 2, 5, 30, 200, 900]) for _ in range(6)] + [3])
    for most in (3, 4, 6):
        got = token_files.code_lengths(counts, most)
        used = np.flatnonzero(counts)
        assert (got > 0).tolist() == (counts > 0).tolist() and got.max() <= most
        if len(used) > 1:
            best = min(sum(k * c for k, c in zip(ks, counts[used])) for ks in itertools.product(range(1, most + 1), repeat=len(used)) if sum(2.0**-k for k in ks) <= 1)
            assert (got * counts).sum() == best and (0.5 ** got[used]).sum() <= 1
    many = token_files.code_lengths(np.arange(1, 1000), 5)
    assert many.max() == 10 and (0.5**many).sum() == 1


# -- 2 --
def test_urls_long_hosts_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "a://" + "x." * 5000 + "example.com/en/" + "y" * 9000), (2, "a://" + ".".join("com" for _ in range(50)) + "/")], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.apply_rules(pages, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("com/", "allow")}
    assert url_filters.apply_rules(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_filters.apply_rules(pages, rules.filter("false"), default="block").collect()} == {"block"}


# -- 4 --
def test_fit_is_bounded_by_rows(spark):
    rows = [(None, f"the quick word {k % 40}", "en") for k in range(3000)] + [(7, f"der schnelle Satz {k}", "de") for k in range(900)] + [(8, None, "de"), (9, "kein", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    model = language_id.Model
    language_id.Model = lambda x, labels: seen.append(Counter(labels)) or model(x, labels)
    try:
        fitted = language_id.fit(frame, rows=100)
    finally:
        language_id.Model = model
    # different rows only: repeats may push others of their part out, but never count themselves
    assert seen[0]["de"] == 100 and 20 <= seen[0]["en"] <= 40 and fitted.langs == ["de", "en"]


# -- 7 --
def test_items_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a, B! x"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), (5, "b c"), (5, "d e")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_leaks(docs, items, null_items=True).collect()}
    assert got == {1: (5, ["5"]), 2: (2, []), 3: (0, [])}
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: (4, ["5"]), 2: (0, []), 3: (0, [])}


# -- 10 --
def brute_quality(rows, least, long_least, depleted, each):
    """Whether each (host, text) is kept, by the rule as written."""
    norm = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
    n, seen = Counter(), set()
    for k, (host, t) in enumerate(rows):
        if t is not None and (each or (host, t) not in seen):
            seen.add((host, t))
            n.update((host, x) for x in {norm(x) for x in t.split("\n")} - {""})
    out = []
    for host, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = list(zip(w, w[1:], w[2:]))
        c, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            hit |= {i, i + 1, i + 2} if c[g] > 1 else set()
        good = len(w) >= 50 and 100 * len(hit) <= 50 * len(w)
        left = [x for x in (t or "").split("\n") if n[host, norm(x)] < (long_least if len(norm(x).split()) >= quality.LONG_WORDS else least) or not norm(x)]
        out.append((host, t, good and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in left) >= len(w) * (1 - depleted)))
    return Counter(out)


@pytest.mark.parametrize("each", [False, True])
def test_quality_verdict_as_by_brute_force(spark, each):
    rnd = random.Random(11)
    pool = [" ".join(f"p{k}w{i}" for i in range(rnd.randint(3, 30))) for k in range(25)]
    rows = []
    for k in range(200):
        lines = [rnd.choice(pool) if rnd.random() < 0.4 else " ".join(f"u{k}x{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 8))]
        rows.append((rnd.choice(["h1", "h2", None]), "\n".join(x.title() if rnd.random() < 0.2 else f" {x}  " for x in lines)))
    rows += [rows[k] for k in range(40)] * 2 + [("h1", None), ("h1", "")]
    frame = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(5)
    got = Counter((r.source, r.text, r.kept) for r in quality.judge(frame, copies=each).collect())
    want = brute_quality(rows, quality.LINE_LEAST, quality.LONG_LEAST, quality.DEPLETED, each)
    assert got == want and len({k for _, _, k in want}) == 2
