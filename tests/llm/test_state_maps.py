"""Chunk state maps of the token counter: cuts, maps, their composition, and texts without white space."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelkit.llm import token_count

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"ab cdeS'\n\t .!?0 9é日", "ing", "the", " and", "<|endoftext|>", "'re", "a" * 9, "-" * 12, " " * 9, "\n\n\n", "''''", "123456", "日本語"]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(BYTE)
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


def test_chunks_of_random_texts(library):
    count, rng = token_count.counter(BYTE), np.random.default_rng(11)
    guessed = 0
    for _ in range(1500):
        text, size = "".join(rng.choice(PARTS, rng.integers(0, 40))), int(rng.integers(1, 20))
        tokens, runs = token_count.split_text(count, text, size)
        for run in runs:
            state, total = token_count.START, 0
            for before, chunk, goes_on in run:
                maps = {e: (x, n) for e, x, n in token_count.state_map(count, before, chunk, goes_on)}
                ((_, left, n),) = token_count.state_map(count, before, chunk, goes_on, entry=state)
                if state in maps:
                    guessed += 1
                    assert maps[state] == (left, n)
                state, total = left, total + n
            assert state == token_count.START
            tokens += total
        assert tokens == library(text), (text, size)
    assert guessed > 1000


def test_scan_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for run in range(12):
        places = int(rng.integers(2, 12))
        maps = [[(f"s{e}", f"s{rng.integers(4)}", int(rng.integers(9))) for e in rng.permutation(4)[: rng.integers(2, 5)]] for _ in range(places)]
        rows += [(7, run, place, m) for place, m in enumerate(maps)]
        for entry in ("s0", "s1", "s2", "s3"):
            state, total = entry, 0
            for m in maps:
                hit = [x for x in m if x[0] == state]
                if not hit:
                    break
                state, total = hit[0][1], total + hit[0][2]
            else:
                want[run, entry] = (state, total)
    maps = spark.createDataFrame(rows, "row long, run int, place int, map array<struct<entry string, exit string, tokens long>>")
    longest = max(r[2] for r in rows)
    got = {(r["run"], m["entry"]): (m["exit"], m["tokens"]) for r in token_count.scan_maps(maps, longest).collect() for m in r["map"]}
    assert got == want


@pytest.mark.parametrize("chunk", [300, 5000])
def test_long_texts_without_white_space(spark, library, chunk):
    rng = np.random.default_rng(4)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000))
    texts = ["a" * 30_001, letters, "日本語の文章" * 2_000, "\n" * 9_999, "-" * 12_000, "0123456789" * 2_000, "'" * 7_001, letters + "<|endoftext|>" + letters[:7_000] + " end of it", "plain words " * 2_000, "", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(docs, BYTE, chunk).collect()}
    assert got == {k: (len((t or "").encode()), library(t or "")) for k, t in enumerate(texts)}


def test_twenty_megabytes_without_white_space(spark, library):
    """One word of 20 MB is dealt over tasks by chunks; each repetition of it adds the same tokens."""
    part = "thequickbrownfoxjumpsoverthelazydog"
    each = library(part * 2_001) - library(part * 2_000)
    number = 20_000_000 // len(part)
    docs = spark.createDataFrame([(1, part)], "doc_id long, text string").selectExpr("doc_id", f"repeat(text, {number}) AS text")
    (row,) = token_count.count_tokens(docs, BYTE).collect()
    assert (row["n_bytes"], row["n_tokens"]) == (number * len(part), library(part * 2_000) + (number - 2_000) * each)
