"""Id ranges, and fingerprints with content words as anchors."""

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F
from test_corpus import brute_likeness, frame

from panelkit.llm import fingerprint
from panelkit.llm.common import IdRanges, documents


@pytest.mark.parametrize("ranges", [4, 64])
@pytest.mark.parametrize("first, more", [(0, [2**62]), (2**60, [-5]), (-(2**62), [None] * 3 + [7] * 40)])
def test_id_ranges(spark, ranges, first, more):
    step = 4096
    ids = [first + k * step for k in range(4000)] + more
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(8)
    found = IdRanges(df, "id", 100, ranges=ranges)
    rows = found.with_bucket(df, "b").collect()
    assert Counter(r["id"] for r in rows) == Counter(ids)
    known = sorted((r["id"], r["b"]) for r in rows if r["id"] is not None)
    assert all(x[1] <= y[1] for x, y in zip(known, known[1:]))
    assert all(r["b"] == found.last > known[-1][1] for r in rows if r["id"] is None)
    sizes = Counter(b for _, b in known)
    assert max(sizes.values()) <= 200 and len(sizes) <= 100


def test_id_ranges_of_nothing(spark):
    for ids in ([], [None], [3]):
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        assert [r["id"] for r in IdRanges(df, "id", 10).with_bucket(df, "b").collect()] == ids


def brute(text, far):
    text = text or ""
    common = set(fingerprint.anchor_words())
    w = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ").split(" ")
    out = set()
    for k, x in enumerate(w):
        before = w[max(0, k - far) : k]
        if x in common or not common.intersection(before):
            after = [y for y in w[k + 1 :] if y not in common][:2]
            if len(after) == 2:
                out.add((x, *after))
    return out or ({text} if text else set())


def test_fingerprints_with_content_anchors(spark, small):
    far = fingerprint.FAR
    other = [" ".join(f"слово{(7 * k + j * j) % 50}" for j in range(60)) for k in range(3)]
    texts = ["", None, "!?", "??", "abc", "the", "of the abc", *other, other[0], other[1] + " the end of this text"]
    made = frame(spark, [(k, t, "en", "s1") for k, t in enumerate(texts)])
    for docs in (made, documents(spark, small).where("n_chars < 4000")):
        text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
        order = sorted(text, reverse=True)
        prints = {}
        for r in fingerprint.edited_fingerprints(docs, far).collect():
            own, following = text[r["doc_id"]], text[order[(order.index(r["doc_id"]) + 1) % len(order)]]
            half = len(own) // 2
            a, b, c = (brute(t, far) for t in (own, own[: len(own) - half] + following[:half], following))
            assert len(r["fingerprint"]) == 16 * len(a)
            assert r["near_edited"] == pytest.approx(brute_likeness(a, b))
            assert r["near_next"] == pytest.approx(brute_likeness(a, c))
            prints.setdefault(r["fingerprint"], set()).add(frozenset(a))
        assert all(len(x) == 1 for x in prints.values())


def test_similar_pairs_of_any_language_and_id(spark, small):
    """Texts without listed words, null ids, an id with unlike texts, copies, and empty texts."""
    far = fingerprint.FAR
    base = [" ".join(f"слово{(7 * k + j * j) % 90}" for j in range(80)) for k in range(3)]
    rows = [(1, base[0]), (2, base[0] + " конец"), (None, base[0] + " другой конец"), (3, base[1]), (3, base[1] + " ещё"), (3, base[2]), (None, base[2]), (4, base[2]), (5, ""), (6, None), (None, base[1] + " и так далее")]
    made = frame(spark, [(i, t, "ru", "s1") for i, t in rows])
    for docs in (made, documents(spark, small).where("n_chars < 3000")):
        least_id = {}
        for r in docs.select("doc_id", "text").collect():
            found, i = frozenset(brute(r["text"], far)), (r["doc_id"] is None, r["doc_id"] or 0)
            if found:
                least_id[found] = min(i, least_id.get(found, i))
        known = sorted((i, sorted(s)) for s, i in least_id.items())
        want = Counter()
        for k, (i, a) in enumerate(known):
            for j, b in known[k + 1 :]:
                x = brute_likeness(set(a), set(b))
                if x >= 0.8:
                    want[None if i[0] else i[1], None if j[0] else j[1], round(x, 9)] += 1
        got = Counter((r["a"], r["b"], round(r["likeness"], 9)) for r in fingerprint.similar_pairs(docs, far=far).collect())
        assert got == want and want
    assert fingerprint.similar_pairs(made.limit(0), far=far).collect() == []
