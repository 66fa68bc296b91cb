"""Token counts by a compiled byte-pair-encoding transducer.

A byte-level BPE tokenizer file is compiled, as far as texts need it, to a deterministic
transducer over bytes.  Reading a byte moves from state to state and *emits a number of
tokens* (which may be negative where a longer token replaces shorter ones), so the count
of a word is the sum along its path.  A state holds every place where a token that is
still open may have begun, with the last token before that place and the token count up
to there, relative to the present one.

Texts of more than a chunk are cut, where possible at a place that no piece of the
pre-tokenizer crosses; every path starts anew there, so such chunks are counted by
themselves.  Where a stretch has no such place, such as a long text without white space,
the cut is inside a piece, and the chunks around it form a *run*.  Each chunk of a run is
a row of its own, with its *state map*: for states it may be entered in, the state it is
left in and the tokens emitted.  Entry states are those that the characters before the
chunk lead to from any of several starts; paths that meet go on as one.  Neighbouring maps
are composed where an exit is an entry, pair by pair, in as many rounds as the longest run
has bits.  A run whose maps lack a state that is really entered, which the result shows,
is read again in order, a chunk at a time.

Edge cases: null text counts as empty (0 bytes, 0 tokens); the special string inside a
text is one token, as the tokenizers library has it; rows are counted one by one, so null
or repeated ids stay separate rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import materialize

#: The Unicode white space that the published pre-tokenizer pattern calls \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the published pre-tokenizer pattern of byte_bpe_50k.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
RARE_WHITE = regex.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000] ")
#: The kinds of characters: white space, letters, numbers, others.
KIND = regex.compile(rf"(?P<white>[{WHITE}])|(?P<letter>\p{{L}})|(?P<number>\p{{N}})|(?P<other>.)", regex.DOTALL)
#: What a piece goes on with at the start of a chunk that begins inside it.
REST = {k: regex.compile(v) for k, v in {"white": rf"[{WHITE}]+(?![^{WHITE}])", "letter": r"\p{L}+", "number": r"\p{N}+", "other": rf"[^{WHITE}\p{{L}}\p{{N}}]+"}.items()}
#: The name of the state that a piece starts in.
START = "0,-1,0"
#: Characters searched for a cut that no piece crosses; characters before a chunk, and places in them, that entry states come from.
LOOK_BACK, CONTEXT, STARTS = 1024, 256, 32
CHUNK_CHARS = 1 << 16
MEMO_WORDS = 400_000
#: Longer words aren't remembered.
MEMO_CHARS = 256
#: Bytes after which paths through a chunk are compared; rows of chunks in an Arrow batch.
BLOCK, BATCH = 256, 128
MAX_STATES = 250_000


def splits_at_spaces(text: str) -> bool:
    """Whether every space in ``text`` follows a character that isn't white space.

    Then no piece of the pre-tokenizer crosses from before a space to after it, and the
    text may be cut in front of every space.
    """
    if text[:1] == " " or any(x in text for x in ("  ", "\n ", "\r ", "\t ", "\v ", "\f ")):
        return False
    return text.isascii() or not RARE_WHITE.search(text)


def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies, by their published rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class CountTransducer:
    """Counts the BPE tokens of byte strings; states and transitions are made on first use."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.byte_id = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merge = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.open = [False]
        for i, data in self.bytes_of.items():
            node = 0
            for b in data:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.open.append(False)
                    self.open[node] = True
                node = nxt
            self.token[node] = i
        #: rank, left and right part of each merged token
        self.made = {t: (rank, a, b) for (a, b), (rank, t) in self.merge.items()}
        self.fits: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.fits.clear()
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merge_all(self, ids: list[int]) -> list[int]:
        """Plain BPE: apply the best-ranked merge, leftmost first, until none applies."""
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids = [*ids[:k], self.merge[ids[k], ids[k + 1]][1], *ids[k + 2 :]]
        return ids

    def stands(self, token: int) -> bool:
        """Whether BPE gives just this token for its bytes."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.merge_all([self.byte_id[b] for b in self.bytes_of[token]]) == [token]
        return found

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE can leave these two tokens side by side.

        Undoes the merges at the seam, the latest first; the pair is impossible if two
        neighbours at the seam would have merged before the merge just undone.
        """
        key = left << 20 | right
        found = self.fits.get(key)
        if found is not None:
            return found
        limit, found = len(self.merge), True
        while True:
            joined = self.merge.get((left, right))
            if joined is not None and joined[0] < limit:
                found = False
                break
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is not None and (made_right is None or made_left[0] > made_right[0]):
                limit, left = made_left[0], made_left[2]
            elif made_right is not None:
                limit, right = made_right[0] + 1, made_right[1]
            else:
                break
        self.fits[key] = found
        return found

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        moved, end = [], None
        for node, last, count in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            moved.append((node, last, count))
            token = self.token[node]
            if end is None and token >= 0 and (self.stands(token) if last < 0 else self.adjacent(last, token)):
                end = token, count + 1
        if end is None:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        token, emitted = end
        after = (*((n, t, c - emitted) for n, t, c in moved if self.open[n]), (0, token, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        self.step[state << 8 | byte] = number, emitted
        return number, emitted

    def read(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after ``data`` and the tokens emitted."""
        total = 0
        get = self.step.get
        for b in data:
            found = get(state << 8 | b)
            state, emitted = found if found is not None else self.transition(state, b)
            total += emitted
        return state, total

    def count(self, data: bytes) -> int:
        self.trim()
        return self.read(0, data)[1]

    def trim(self) -> None:
        """Forget the states made so far if they are very many; their numbers are void then."""
        if len(self.states) > MAX_STATES:
            self.reset()

    def name(self, state: int) -> str:
        """A state as text, which is the same in every process."""
        return ";".join(",".join(map(str, place)) for place in self.states[state])

    def named(self, name: str) -> int:
        places = tuple(tuple(map(int, place.split(","))) for place in name.split(";"))
        if places not in self.number:
            self.number[places] = len(self.states)
            self.states.append(places)
        return self.number[places]

    def states_after(self, context: str) -> list[int]:
        """The states that ``context`` leads to from a start at any of its first places."""
        states: set[int] = set()
        for k, char in enumerate(context):
            if k < STARTS:
                states.add(0)
            for b in char.encode():
                states = {self.read(s, bytes([b]))[0] for s in states}
        return sorted(states)

    def read_from(self, entries: list[int], data: bytes) -> list[tuple[int, int]]:
        """``read`` from each of the entry states; paths that meet go on as one."""
        paths, path_of, tokens = list(entries), list(range(len(entries))), [0] * len(entries)
        for at in range(0, len(data), BLOCK):
            moved = [self.read(state, data[at : at + BLOCK]) for state in paths]
            tokens = [n + moved[p][1] for n, p in zip(tokens, path_of)]
            merged: dict[int, int] = {}
            path_of = [merged.setdefault(moved[p][0], len(merged)) for p in path_of]
            paths = list(merged)
        return [(paths[p], n) for p, n in zip(path_of, tokens)]


class TextCounter:
    """Token counts of texts; remembers a bounded number of words."""

    class _Memo(dict):
        def __init__(self, count):
            self.count = count

        def __missing__(self, key):
            if len(key) > MEMO_CHARS:
                return self.count(key)
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[key] = n = self.count(key)
            return n

    def __init__(self, path: str):
        self.transducer = CountTransducer(path)
        self.special = regex.compile("|".join(map(regex.escape, self.transducer.special)) or "(?!)")
        self.piece = self._Memo(lambda p: self.transducer.count(p.encode()))
        self.word = self._Memo(lambda w: sum(map(self.piece.__getitem__, PIECES.findall(" " + w))))

    def plain(self, text: str) -> int:
        if not splits_at_spaces(text.removeprefix(" ")):
            return sum(map(self.piece.__getitem__, PIECES.findall(text)))
        first, *rest = text.split(" ")
        return sum(map(self.piece.__getitem__, PIECES.findall(first))) + sum(map(self.word.__getitem__, rest))

    def count(self, text: str) -> int:
        if any(s in text for s in self.transducer.special):
            return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))
        return self.plain(text)


@functools.lru_cache(2)
def counter(path: str) -> TextCounter:
    """One counter for each worker process and tokenizer file."""
    return TextCounter(path)


def kind(char: str) -> str:
    return KIND.match(char).lastgroup


def border(text: str, i: int) -> str | None:
    """What is known of a cut before character ``i``: "between" pieces, "inside" one, or nothing."""
    a, b = kind(text[i - 1]), kind(text[i])
    if b == "white":
        if a != "white":
            return "between"
        # the last of several may belong to the next piece
        return "inside" if i + 1 == len(text) or kind(text[i + 1]) == "white" else None
    if a == "white":
        return None
    if a != b:
        # an apostrophe may take letters along
        return None if (a, b) == ("other", "letter") else "between"
    if a == "letter" and (i < 3 or kind(text[i - 2]) != "letter" or kind(text[i - 3]) != "letter"):
        return None
    return "inside"


def cuts(text: str, size: int):
    """(start, end, whether a piece goes on after the end) of chunks of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        first, inside = start + size, None
        for at in range(first, max(start, first - LOOK_BACK), -1):
            found = border(text, at)
            if found == "between":
                break
            if found == "inside" and inside is None:
                inside = at
        else:
            at = inside
            if at is None:
                at = next((k for k in range(first + 1, len(text)) if border(text, k)), len(text))
            found = border(text, at) if at < len(text) else "between"
        yield start, at, found == "inside"
        start = at
    if start < len(text):
        yield start, len(text), False


def split_text(count: TextCounter, text: str, size: int) -> tuple[int, list[list[tuple[str | None, str, bool]]]]:
    """The tokens outside runs, and the runs: (characters before, chunk, whether a piece goes on) each."""
    if len(text) <= size:
        return count.count(text), []
    special = count.special.findall(text)
    tokens, runs = len(special), []
    for part in count.special.split(text) if special else [text]:
        run = []
        for start, end, goes_on in cuts(part, size):
            if run or goes_on:
                run.append((part[max(0, start - CONTEXT) : start] if run else None, part[start:end], goes_on))
            else:
                tokens += count.plain(part[start:end])
            if run and not goes_on:
                runs.append(run)
                run = []
    return tokens, runs


def state_map(count: TextCounter, before: str | None, chunk: str, goes_on: bool, entry: str | None = None) -> list[tuple[str, str, int]]:
    """(entry, exit, tokens) of a chunk; ``before`` is None if it starts with a piece.

    With ``entry`` for that state alone, else for the states that ``before`` may lead to.
    """
    t, own, tokens, last = count.transducer, "", 0, ""
    if before is not None:
        same = kind(chunk[0])
        own = REST[same].match(chunk).group()
        first = len(before)
        while first and kind(before[first - 1]) == same:
            first -= 1
        before = before[first:]
    pieces = PIECES.findall(chunk[len(own) :])
    if goes_on and pieces:
        last = pieces.pop()
    tokens = sum(map(count.piece.__getitem__, pieces))
    # from here on states are held by number
    t.trim()
    entries = [t.named(entry)] if entry is not None else [0] if before is None else t.states_after(before)
    ends = t.read_from(entries, own.encode())
    leaves = t.read(0, last.encode())
    if not goes_on:
        return [(t.name(e), START, n + tokens) for e, (_, n) in zip(entries, ends)]
    if last:
        return [(t.name(e), t.name(leaves[0]), n + tokens + leaves[1]) for e, (_, n) in zip(entries, ends)]
    return [(t.name(e), t.name(left), n) for e, (left, n) in zip(entries, ends)]


_PART_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("tokens", pa.int64()), ("run", pa.int32()), ("place", pa.int32()), ("before", pa.string()), ("chunk", pa.string()), ("goes_on", pa.bool_())])
_PARTS = "row long, doc_id long, n_bytes long, tokens long, run int, place int, before string, chunk string, goes_on boolean"
_MAP = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("tokens", pa.int64())]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(schema), schema.types)], schema=schema)


def _parts(path: str, chunk_chars: int):
    """A row for each text with the tokens outside runs, and a row for each chunk of a run."""

    def run(batches):
        count, row = counter(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, chunks = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                text = text or ""
                tokens, runs = split_text(count, text, chunk_chars)
                texts.append((row, doc_id, len(text.encode()), tokens, None, None, None, None, None))
                for k, parts in enumerate(runs):
                    for place, part in enumerate(parts):
                        chunks.append((row, None, None, None, k, place, *part))
                        if len(chunks) == BATCH:
                            yield _batch(chunks, _PART_SCHEMA)
                            chunks = []
                row += 1
            yield _batch(texts + chunks, _PART_SCHEMA)

    return run


def _maps(path: str):
    def run(batches):
        count = counter(path)
        for batch in batches:
            found = [[dict(zip(("entry", "exit", "tokens"), m)) for m in state_map(count, *part)] for part in zip(*(batch[c].to_pylist() for c in ("before", "chunk", "goes_on")))]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["run"], batch["place"], pa.array(found, _MAP)], names=["row", "run", "place", "map"])

    return run


def _in_order(path: str):
    """Tokens of the chunks of runs that come sorted by row, run and place."""

    def run(batches):
        count, state = counter(path), START
        for batch in batches:
            tokens = []
            for place, *part in zip(*(batch[c].to_pylist() for c in ("place", "before", "chunk", "goes_on"))):
                ((_, state, n),) = state_map(count, *part, entry=state if place else START)
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(tokens, pa.int64())], names=["row", "tokens"])

    return run


def _composed(x: Column, y: Column) -> Column:
    """The state map of a chunk with map ``x`` and the next with map ``y``; composition is associative."""
    then = lambda e: F.transform(
        F.filter(y, lambda f: f["entry"] == e["exit"]),
        lambda f: F.struct(e["entry"].alias("entry"), f["exit"].alias("exit"), (e["tokens"] + f["tokens"]).alias("tokens")),
    )
    return F.flatten(F.transform(x, then))


def scan_maps(maps: DataFrame, longest: int) -> DataFrame:
    """(row, run, map): the maps of (row, run, place, map) composed over each run, ``longest`` being the last place."""
    for _ in range(longest.bit_length()):
        pairs = maps.groupBy("row", "run", F.shiftright("place", 1).alias("half"))
        pairs = pairs.agg(F.min_by("map", "place").alias("x"), F.max_by("map", "place").alias("y"), F.count(F.lit(1)).alias("n"))
        both = F.when(F.col("n") == 1, F.col("x")).otherwise(_composed(F.col("x"), F.col("y")))
        maps = pairs.select("row", "run", F.col("half").alias("place"), both.alias("map"))
    return maps.select("row", "run", "map")


def _run_tokens(chunks: DataFrame, longest: int, number: int, path: str) -> DataFrame:
    """(row, tokens) of the chunks of runs."""
    spark = chunks.sparkSession
    tasks = min(number, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a number of tasks, as the rows are small for the work they take
    maps = chunks.repartition(tasks, "row", "run", "place").mapInArrow(_maps(path), "row long, run int, place int, map array<struct<entry string, exit string, tokens long>>")
    whole = F.get(F.filter("map", lambda m: m["entry"] == START), F.lit(0))["tokens"]
    runs = materialize(scan_maps(maps, longest).select("row", "run", whole.alias("tokens")), "runs")
    missing = runs.where("tokens is null").select("row", "run")
    found = runs.where("tokens is not null").select("row", "tokens")
    if missing.isEmpty():
        return found
    again = chunks.join(missing, ["row", "run"], "left_semi").repartition("row", "run").sortWithinPartitions("row", "run", "place")
    return found.unionByName(again.mapInArrow(_in_order(path), "row long, tokens long"))


def count_tokens(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``path`` is a byte-level BPE tokenizer file."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_parts(path, chunk_chars), _PARTS)
    parts = materialize(parts, "token-counts")
    texts = parts.where("run is null").select("row", "doc_id", "n_bytes", "tokens")
    chunks = parts.where("run is not null").select("row", "run", "place", "before", "chunk", "goes_on")
    longest, number = chunks.agg(F.max("place"), F.count(F.lit(1))).first()
    if not number:
        return texts.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"))
    more = _run_tokens(chunks, longest, number, path).groupBy("row").agg(F.sum("tokens").alias("more"))
    n_tokens = F.col("tokens") + F.coalesce("more", F.lit(0))
    return texts.join(more, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"))


def token_limits(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Counts of every document and whether it exceeds ``limit`` tokens."""
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
