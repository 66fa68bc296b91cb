"""Corpus operators against brute force, and on odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelkit.llm import fingerprint, id_files, language_id, line_dedup, lm_score, mixing, near_dup, packing, quality, token_count
from panelkit.llm.common import crc_mod, documents
from panelkit.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, row long, b int, size long, line int, n int, word string, key string, shard int"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names operators might use."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *[None] * 9) for r in rows], SCHEMA)


ODD = [
    (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", None, None), (None, "a null id has words", "en", "s2"),
    (4, "one two three four five six seven\nsecond line of this text\n\nOne two three four five six seven", "en", "s1"),
    (5, "one two three four five six seven\nsecond line of this text\n\nOne two three four five six seven", "en", "s1"),
    (5, "one two three four five six seven\nsecond line of this text\n\nOne two three four five six seven", "en", "s1"),
    (6, "word " * 5000, "en", "s2"), (7, "12 34 !? 　", "de", "s2"), (8, "don't <|endoftext|> we'll  x", "de", "s3"),
    (9, "é" * 3000 + " ünï " * 700, "fr", "s3"), (-3, "short", "fr", None), (2**62, "far away id", "en", "s1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in documents(spark, sf).select("doc_id", "text").collect()}


def split(text):
    return (text or "").encode().split()


# -- token counts ---------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_token_counts_equal_the_library(spark, small, odd, chunk):
    library = Tokenizer.from_file(BYTE)
    for docs in (documents(spark, small).limit(60), odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
        got = Counter(tuple(r) for r in token_count.count_tokens(docs, BYTE, chunk).collect())
        assert got == want


def test_transducer_on_random_bytes():
    library, count = Tokenizer.from_file(BYTE), token_count.counter(BYTE)
    rng = np.random.default_rng(5)
    letters = list("ab cdeS'\n\t .!?0 9é日  ") + ["ing", "the", " and", "<|endoftext|>"]
    for _ in range(800):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert count.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts_of_nothing(empty):
    assert token_count.token_limits(empty, BYTE).collect() == []


# -- quality --------------------------------------------------------------------------


def brute_measures(text):
    w = split(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, medium, odd):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    for docs in (documents(spark, medium), odd):
        text = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        want = defaultdict(set)
        for i, t in text:
            want[i].add(brute_measures(t))
        rows = quality.judge(docs, labels).collect()
        assert len(rows) == docs.count()
        for r in rows:
            m = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            assert m in want[r["doc_id"]], (r, want[r["doc_id"]])
            assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
            assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_good_documents(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    judged = quality.judge(documents(spark, medium), labels, risk=0.2).join(labels, "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("not kept").count() <= 0.05 * good.count()
    assert bad.count() == 0 or bad.where("kept").count() < bad.count()


def test_binomial_tail(spark):
    cases = [(0, 10, 0.3), (2, 10, 0.3), (3, 1000, 0.01), (5, 1000, 0.01), (900, 100_000, 0.01), (9, 10, 0.3)]
    for k, n, p in cases:
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(want if k < n * p else 1.0, rel=1e-6)


def test_quality_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(odd, labels).collect())
    assert quality.judge(empty, labels).collect() == []


# -- mixing ---------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_names, target = share * sum(sizes.values()), set(names), {}
    while open_names:
        level = left / sum(w[s] for s in open_names)
        full = {s for s in open_names if level * w[s] > most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_names}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_names -= full
    return target


def test_mixing(spark, medium, odd, empty):
    for docs in (documents(spark, medium), odd):
        rows = docs.select("doc_id", "source", "text").collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(split(r["text"]))
        want = brute_targets(sizes)
        got = mixing.mix_sizes(docs.withColumn("s", F.col("source")), [3, 1, 2]).collect()
        assert len(got) == len(rows)
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
        source = {(r["doc_id"], len(split(r["text"]))): r["source"] for r in rows}
        taken, target = Counter(), {}
        for r in got:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s]
            assert r["target"] == pytest.approx(want[s])
            taken[s] += r["taken"]
        for s in taken:
            assert abs(taken[s] - want[s]) <= 2
        again = mixing.mix_sizes(docs, [3, 1, 2]).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_sizes(empty, [3, 1, 2]).collect() == []


def test_mix_repeats_rows(spark, small):
    docs = documents(spark, small)
    sizes = {r["doc_id"]: r for r in mixing.mix_sizes(docs, [3, 1, 2]).collect()}
    out = mixing.mix(docs, [3, 1, 2])
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(split(r["text"]))
    assert all(words[i] == r["taken"] for i, r in sizes.items())


# -- token-id files -------------------------------------------------------------------


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(1000))])
def test_byte_code_round_trip(values):
    v = np.array(values, "<u4")
    control, data = id_files.pack(v)
    assert id_files.unpack(control, data, len(v)).tolist() == values
    if values:
        with pytest.raises(ValueError):
            id_files.unpack(control, data + b"\0", len(v))


def test_id_files(spark, small, odd, empty, tmp_path):
    library = Tokenizer.from_file(WORD)
    for n, docs in enumerate((documents(spark, small), odd)):
        rows = docs.select("doc_id", "text").collect()
        ids = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in rows]
        path = f"file://{tmp_path}/{n}"
        id_files.write_ids(docs, path, WORD, 1, rows_per_shard=16, block_ids=2000)
        stored = id_files.read_ids(spark, path).collect()
        assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in stored) == Counter((i, tuple(x)) for i, x in ids)
        got = sorted(id_files.stored_digest(spark, path).collect(), key=lambda r: r["start"])
        start, last = 0, None
        for r in got:
            assert r["start"] == start
            assert last is None or r["doc_id"] is None or last <= r["doc_id"]
            start, last = start + r["n_tokens"], r["doc_id"]
        crc = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crc
    id_files.write_ids(empty, f"file://{tmp_path}/e", WORD, 1)
    assert id_files.stored_digest(spark, f"file://{tmp_path}/e").collect() == []


# -- fingerprints ---------------------------------------------------------------------


def brute_spots(text):
    import regex

    common = set(fingerprint.anchor_words())
    w = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).strip(" ").split(" ")
    content = [k for k, x in enumerate(w) if x not in common]
    out = set()
    for k, x in enumerate(w):
        after = [w[c] for c in content if c > k][:2] if x in common else []
        if len(after) == 2:
            out.add((x, *after))
    return out


def brute_likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints(spark, small, odd):
    for docs in (documents(spark, small).where("n_chars < 4000"), odd.where("doc_id is not null and doc_id <> 5 and doc_id <> 6")):
        text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
        order = sorted(text, reverse=True)
        got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
        assert sorted(got) == sorted(text)
        for k, i in enumerate(order):
            own, following = text[i], text[order[(k + 1) % len(order)]]
            half = len(own) // 2
            edited = own[: len(own) - half] + following[:half]
            r = got[i]
            assert r["n_chars"] == len(own)
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = map(brute_spots, (own, edited, following))
            assert len(r["fingerprint"]) == 16 * len(a)
            assert r["near_edited"] == pytest.approx(brute_likeness(a, b))
            assert r["near_next"] == pytest.approx(brute_likeness(a, c))


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprint.edited_fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["doc_id"], r["n_chars"]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint.edited_fingerprints(empty).collect() == []


def test_similar_pairs(spark, medium):
    docs = documents(spark, medium).where("n_chars < 6000")
    sets = {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        s = frozenset(brute_spots(r["text"]))
        if s and s not in sets:
            sets[s] = r["doc_id"]
    known = list(sets.items())
    want = {(min(i, j), max(i, j)) for k, (a, i) in enumerate(known) for b, j in known[k + 1 :] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and brute_likeness(a, b) >= 0.8}
    got = {(r["a"], r["b"]) for r in fingerprint.similar_pairs(docs).collect()}
    assert got == want


# -- packing --------------------------------------------------------------------------


def check_packing(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_packing(spark, medium, odd, empty):
    library = Tokenizer.from_file(BYTE)
    for docs in (documents(spark, medium), odd):
        rows = packing.pack_documents(docs, BYTE, 2).collect()
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids), 1024), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        used, total = check_packing(rows, 1024), sum(r["length"] for r in rows)
        assert used <= max(-(-total // 1024) * 1.01 + 1, 1)
    assert packing.pack_documents(empty, BYTE, 2).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.permutation(np.arange(1, 1025))[: 40 * (seed + 1)], rng.integers(1, 3000, 40 * (seed + 1)))}
    plan, sequences = packing.plan_packing(counts)
    room, ranks = Counter(), defaultdict(list)
    for length, first, n, sequence, each, offset in plan:
        ranks[length].append((first, n))
        assert n % each == 0
        for k in range(n // each):
            room[sequence + k] += each * length
    assert all(v <= 1024 for v in room.values()) and len(room) == sequences
    for length, runs in ranks.items():
        at = 0
        for first, n in sorted(runs):
            assert first == at
            at += n
        assert at == counts[length]
    assert len(plan) < 40_000


# -- language-model scores ------------------------------------------------------------


def test_lattice_sums_all_segmentations():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counts = np.random.default_rng(1).integers(0, 50, sp.get_piece_size()).astype(float)
    model = lm_score.PieceModel(PIECE, counts, 10)
    total = counts[[k for k in range(len(counts)) if not (sp.is_control(k) or sp.is_unknown(k))]].sum() + 10 + lm_score.SMOOTH * (sum(not (sp.is_control(k) or sp.is_unknown(k)) for k in range(len(counts))) + 1)
    logp = {sp.id_to_piece(k): math.log((counts[k] + lm_score.SMOOTH) / total) for k in range(len(counts)) if not (sp.is_control(k) or sp.is_unknown(k))}
    pieces = {p: lp for p, lp in logp.items() if not (p.startswith("<0x") and len(p) == 6)}

    def slow(word):
        s = "▁" + word
        alpha = [1.0] + [0.0] * len(s)
        for end in range(1, len(s) + 1):
            for start in range(end):
                if s[start:end] in pieces:
                    alpha[end] += alpha[start] * math.exp(pieces[s[start:end]])
            if s[end - 1] not in pieces:
                alpha[end] += alpha[end - 1] * math.exp(sum(logp[f"<0x{b:02X}>"] for b in s[end - 1].encode()))
        return math.log(alpha[-1])

    words = ["the", "thing", "a", "straße", "日本", "\U0001f600x", "", "thereforeand"]
    assert model.words(words) == pytest.approx([slow(w) for w in words], rel=1e-9)


def test_lm_scores(spark, medium, odd, empty):
    for docs in (documents(spark, medium), odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
        tokens = {(i, t): [*(t or "").encode().lower().split(), None] for i, t in rows}
        count = Counter()
        for i, t in rows:
            if not held(i):
                count.update(tokens[i, t])
        n, v = sum(count.values()), len(count)
        want = Counter()
        for i, t in rows:
            w = tokens[i, t]
            base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
            want[i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(base, 4)] += 1
        got = lm_score.score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2, PIECE).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        if n > 10_000:
            out = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in out) > 1.4 * sum(r["base_score"] for r in out)
    assert lm_score.score_documents(empty, crc_mod(F.col("doc_id"), 7) == 2, PIECE).collect() == []


# -- language ID ----------------------------------------------------------------------


def test_language_accuracy(spark, medium):
    docs = documents(spark, medium)
    found = language_id.identify(docs, crc_mod(F.col("doc_id"), 5) == 0).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_language_of_mixtures_and_odd_rows(spark, medium, odd, empty):
    docs = documents(spark, medium)
    model = language_id.fit(docs)
    text = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(20).collect()) for lang in model.languages}
    for lang, t in text.items():
        assert model.predict(t[:3000])[0] == lang and model.predict(t[:3000])[1] > 0.9
    lang, share = model.predict(text["en"][:6000] + " " + text["de"][:3000])
    assert lang == "en" and 0.5 < share < 0.85
    rows = language_id.identify(odd, crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert len(rows) == len(ODD)
    pred = {r["doc_id"]: r for r in rows}
    assert {pred[i]["lang_pred"] for i in (1, 2, 3, 7)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify(empty, crc_mod(F.col("doc_id"), 5) == 0).collect() == []


# -- near duplicates ------------------------------------------------------------------


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    at, links = defaultdict(list), defaultdict(set)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    for ids in at.values():
        if len(ids) <= 60:
            for a in ids:
                links[a].update(ids)
    for x, ids in at.items():
        if len(ids) > 60:
            for a in ids:
                links[a].update(ids)
    component = {}
    for i in sorted(sets):
        if i in component:
            continue
        todo = [i]
        component[i] = i
        while todo:
            a = todo.pop()
            for b in links[a]:
                if b not in component:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        component[b] = i
                        todo.append(b)
    return {i: (len(s), component[i]) for i, s in sets.items()}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, medium, width, percent):
    docs = documents(spark, medium)
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], width, percent)
    got = near_dup.near_duplicates(docs, width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicate_chains(spark):
    """A long chain of small edits: the ends aren't similar, the component is one."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    rows, text = [], list(words)
    for i in range(60):
        rows.append((100 + i, " ".join(text), "en", "s"))
        for k in rng.integers(0, 300, 4):
            text[k] = f"x{i}-{k}"
    rows += [(5, "lone text of few words", "en", "s"), (6, "lone text of few words", "en", "s")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_groups([(r[0], r[1]) for r in rows], 3, 85).items()}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dup.near_duplicates(odd, 3, 85).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 4
    assert by_id[1]["component_id"] == 1 and by_id[2]["component_id"] == 2 and by_id[2]["n_shingles"] == 0
    assert near_dup.near_duplicates(empty, 3, 85).collect() == []


# -- line dedup -----------------------------------------------------------------------


def brute_lines(rows, width=5, least=0.8):
    """Lines to remove of each row, and links of its lines to other classes of lines."""
    sets, order = {}, []
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            w = line.lower().encode().split()
            if w:
                s = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1)))
                order.append((i, k, s))
                sets.setdefault(s, len(sets))
    at, near = defaultdict(set), defaultdict(set)
    for s in sets:
        for x in s:
            at[x].add(s)
    for s in sets:
        for other in set().union(*(at[x] for x in s)):
            if other != s and len(s & other) >= least * len(s | other):
                near[s].add(other)
    removed, links, seen = defaultdict(list), Counter(), set()
    for i, k, s in order:
        if s in seen or near[s] & seen:
            removed[i].append(k)
        links[i] += len(near[s])
        seen.add(s)
    return removed, links


def test_line_dedup(spark, medium):
    docs = documents(spark, medium)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    removed, links = brute_lines(rows)
    text = dict(rows)
    for r in line_dedup.dedup_lines(docs).collect():
        assert r["removed_lines"] == removed[r["doc_id"]], r["doc_id"]
        assert r["n_links"] == links[r["doc_id"]]
        assert r["text"] == "\n".join(x for k, x in enumerate(text[r["doc_id"]].split("\n")) if k not in set(removed[r["doc_id"]]))


def test_line_dedup_with_common_passages(spark):
    """Lines that share a very common passage."""
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(80):
        own = " ".join(f"o{x}" for x in rng.integers(0, 40, 14))
        rows.append((i, f"{passage} {own}\n{own} {passage}\nline {i % 7} of few\n", "en", "s"))
    removed, links = brute_lines([(r[0], r[1]) for r in rows])
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {i: removed[i] for i in range(80)}
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: links[i] for i in range(80)}


def test_line_dedup_of_odd_rows(odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.columns[: len(odd.columns)] != [] and got.count() == len(ODD)
    rows = defaultdict(list)
    for r in got.collect():
        rows[r["doc_id"]].append(r)
    assert rows[4][0]["removed_lines"] == [3]
    assert all(r["text"] == "" for r in rows[5]) or all(r["removed_lines"] == [0, 1, 3] for r in rows[5])
    assert rows[1][0]["text"] is None and rows[1][0]["n_lines"] == 0
    assert line_dedup.dedup_lines(empty).collect() == []


# -- pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline

    docs = documents(spark, small)
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, small).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        if name == "lines":
            removed, _ = brute_lines(rows)
            want = {}
            for i, t in rows:
                left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(removed[i]))
                if left.split():
                    want[i] = left
            assert {r["doc_id"]: r["text"] for r in after.collect()} == want
        if name == "near_duplicates":
            want = {i for i, (_, c) in brute_groups(rows, 5, 80).items() if i == c}
            assert {r["doc_id"] for r in after.collect()} == want
        if name == "mix":
            sizes = Counter()
            for r in before.collect():
                sizes[r["source"]] += len(split(r["text"]))
            got = Counter()
            for r in after.collect():
                got[r["source"]] += len(split(r["text"]))
            for s, target in brute_targets(sizes).items():
                assert abs(got[s] - target) <= 2
        if name == "pack":
            check_packing(after.collect(), 1024)
        before = after


def test_repeated_ids_with_unlike_texts(spark):
    """Each row is judged by its own text: a text is lost only to a near copy of it."""
    words = [f"w{k}" for k in range(40)]
    a, b, c = " ".join(words), " ".join(f"other{k}" for k in range(30)), " ".join(f"third{k}" for k in range(25))
    near = " ".join([*words, "end"])
    rows = [(3, a), (5, a), (5, b), (9, c), (5, b), (7, near), (7, c + " more"), (7, None), (8, ""), (8, "x y"), (None, a), (None, a), (-4, b + " z"), (11, "x y"), (11, "q")]
    got = near_dup.one_of_each(frame(spark, [(i, t, "en", "s") for i, t in rows]), 5, 80)
    assert got.columns == frame(spark, []).columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    # one of each group of texts, by the least id where it is its own; empty texts and null ids stay
    want = [(3, a), (-4, b + " z"), (7, c + " more"), (7, None), (8, ""), (8, "x y"), (11, "q"), (None, a), (None, a)]
    assert kept == sorted(want, key=repr)
    assert near_dup.one_of_each(frame(spark, []), 5, 80).count() == 0


def test_recall_near_the_bound(spark):
    """Pairs of random sets whose similarity is just above the bound, all found."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for k in range(400):
        percent, width = (80, 5) if k % 2 else (85, 3)
        n = int(rng.integers(13, 120))
        # one text is the other with so many words cut off its end that the link just holds
        shingles = n - width + 1
        left = max(1, -(-percent * shingles // 100))
        text = [f"{k}.{x}" for x in rng.integers(0, 10**9, n)]
        rows += [(2 * k, " ".join(text), percent), (2 * k + 1, " ".join(text[: left + width - 1]), percent)]
    table = spark.createDataFrame(rows, "doc_id long, text string, percent int")
    for percent, width in ((80, 5), (85, 3)):
        found = near_dup.near_duplicates(table.where(F.col("percent") == percent), width, percent).collect()
        assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in found)


def test_queries_are_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{k}" for k in range(1, 14)] and names[-1] == "pipeline"


# -- further cases of token-id files ----------------------------------------------------


def test_id_files_ascend_bytewise(spark, tmp_path):
    """The files in the order of their names, decoded with numpy alone, are the ids in order of doc_id."""
    import glob

    import pyarrow.parquet as pq

    library = Tokenizer.from_file(WORD)
    rows = [(i, f"text {i} of some words", "en", "s") for i in (*range(50), 2**62, 2**53 + 1, 2**53, 2**53 + 2, -(2**62))]
    rows += [(7, f"repeated id {k % 5}", "en", "s") for k in range(60)] + [(None, f"null id {k % 3}", "en", "s") for k in range(40)]
    rows.append((90, "x" * 30_000 + " long", "en", "s"))
    id_files.write_ids(frame(spark, rows), f"file://{tmp_path}/f", WORD, 1, rows_per_shard=10, block_ids=100)
    rank = {r["rank"]: r["id"] for r in pq.read_table(f"{tmp_path}/f/ranking").to_pylist()}
    got, files = [], sorted(glob.glob(f"{tmp_path}/f/blocks/part-*.parquet"))
    for f in files:
        for block in pq.read_table(f).to_pylist():
            ids = [rank[x] for x in id_files.unpack(block["control"], block["data"], sum(block["lengths"])).tolist()]
            at = 0
            for i, n in zip(block["doc_ids"], block["lengths"]):
                got.append((i, tuple(ids[at : at + n])))
                at += n
    assert len(files) > 8
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i or 0))
    assert Counter(got) == Counter((i, (*library.encode(t, add_special_tokens=False).ids, 1)) for i, t, *_ in rows)
    start, want = 0, []
    for i, ids in got:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, id_files.stored_digest(spark, f"file://{tmp_path}/f").collect()), key=lambda r: r[1]) == want


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_encoder_equals_the_library(path):
    from panelkit.llm.encoders import WordEncoder

    bits = [*"ab cdeS'\n\t .!?0 9é日  Ǆİ×ßΣ́ſ\x1c\x85\xa0 \v\f\r", "ing", "the", " and", "<|endoftext|>", "\n\n", "don't", "Straße", "éa", "é", "ΑΣ", " x\n\n\ny ", "ﬁ"]
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(bits, rng.integers(0, 40))) for _ in range(3000)] + ["", "x" * 5000, "A.\nB c\n\n\nd"]
    coder = WordEncoder(path)
    assert coder.encode(texts) == [coder.whole(t) for t in texts]


# -- further cases of line dedup --------------------------------------------------------


def test_line_dedup_of_many_near_copies(spark):
    """Groups of lines at all distances around the bound, short ones too, and clashing column names."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in rng.integers(0, 500, int(rng.integers(1, 70)))]
        for i in range(25):
            w = list(base)
            for k in rng.integers(0, len(w), rng.integers(0, 4)):
                w[k] = f"e{rng.integers(0, 6)}"
            cut = int(rng.integers(0, 4))
            rows.append((int(rng.integers(0, 60)) + 100 * i, " ".join(w[cut:]) + "\tx\n" + " ".join(base[: len(base) // 2]), "en", "s"))
    rows = list({r[0]: r for r in rows}.values())
    removed, links = brute_lines([(r[0], r[1]) for r in rows])
    docs = frame(spark, rows).withColumn("__id", F.lit(5)).withColumn("__hash", F.lit("x")).withColumn("__removed", F.lit(1)).withColumn("n_links", F.lit(None).cast("string"))
    got = line_dedup.dedup_lines(docs).collect()
    assert {r["doc_id"]: (r["removed_lines"], r["n_links"]) for r in got} == {r[0]: (removed[r[0]], links[r[0]]) for r in rows}
    assert all((r["__id"], r["__hash"], r["__removed"]) == (5, "x", 1) for r in got)
    assert sum(map(len, removed.values())) > 50 and sum(links.values()) > 50


# -- further cases of near duplicates ---------------------------------------------------


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_of_small_and_hot_groups(spark, width, percent):
    """Small sets, and a large group of copies at all distances around the bound."""
    rng = np.random.default_rng(7)
    rows, base = [], [f"b{k}" for k in range(120)]
    for i in range(400):
        w = list(base)
        for j, k in enumerate(rng.integers(0, 120, rng.integers(0, 8))):
            w[k] = f"e{i}-{j}" if rng.random() < 0.8 else "shared"
        rows.append((1000 + i, " ".join(w), "en", "s"))
    for i in range(300):
        n = int(rng.integers(1, 18))
        start = int(rng.integers(0, 3))
        rows.append((5000 + i, " ".join(f"s{i % 40}-{k}" for k in range(start, start + n)), "en", "s"))
    want = {i: c for i, (_, c) in brute_groups([(r[0], r[1]) for r in rows], width, percent).items()}
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows), width, percent).collect()}
    assert got == want
    assert 100 < len(set(want.values())) < 600


# -- further cases of the pipeline ------------------------------------------------------


def test_pipeline_of_odd_rows(spark, small, tmp_path):
    """Nulls, repeated rows, clashing column names and empty tables through every stage."""
    import corpus_pipeline

    base = documents(spark, small).limit(40).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    first = base.first()
    more = spark.createDataFrame([(first["doc_id"], first["text"], "en", "s", 1), (None, "a null id has many words of its own here", "en", None, 1), (10**12, None, None, None, None), (10**12 + 1, "12 34", "en", "s", 5), (10**12 + 2, " ", "en", "s", 1)], base.schema)
    names = ["lang_pred", "score", "__text", "__id", "__hash", "__removed", "n_links", "key", "size", "row", "bucket", "length", "piece"]
    docs = base.unionByName(more).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for start in (docs, docs.limit(0)):
        before = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{start is docs}-{k}"
            stage(spark, before, small).write.parquet(path)
            before = spark.read.parquet(path)
            if k < 4:
                assert before.columns == docs.columns
                assert all(r[c] == n for r in before.collect() for n, c in enumerate(names))
            if name == "near_duplicates":
                ids = [r["doc_id"] for r in before.collect()]
                assert len(ids) == len(set(ids)) and (None in ids) == (start is docs)
                assert not {10**12, 10**12 + 1, 10**12 + 2} & set(ids)
        assert (before.count() > 0) == (start is docs)
