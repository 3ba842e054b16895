"""Byte-level BPE: a streaming transducer with bounded lookahead, and its decoder.

Encoding.  A text is cut at the special tokens and then into pieces by the
usual pattern; merges never cross a piece.  ``Encoder`` takes a text in
chunks and emits a token as soon as no later character can change it:

* a piece is settled once ``PIECE_AHEAD`` characters follow it;
* inside a long piece a token is settled once ``lookahead`` bytes follow it.
  ``sufficient_lookahead`` computes that bound from the merge list: a token
  can only be changed from the right by an earlier merge that takes its right
  end, which itself needs its right part settled, and so on; priorities fall
  strictly along such a chain, so one pass over the merges in order finds the
  longest one.

So the state is a bounded buffer whatever the length of the text.  Short
pieces come in large numbers: the unknown ones of a batch are merged together
(``merge_words``, one vector step per merge round) and kept in a bounded
table per worker process, which lets go of those that came up in one batch
only.  The ids of a batch are one gather from that table.

Decoding.  ``Decoder`` turns ids to bytes and bytes to text with an
incremental UTF-8 state machine; bytes that are no UTF-8 become U+FFFD.

Cases: a null or empty text has no tokens and decodes to the empty text.
Special tokens in a text become their id, as the reference tokenizer does by
default.  Repeated rows are encoded alike.  An unknown id in ``decode`` adds
nothing; a null list decodes to the empty text.  Extra columns are kept.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, documents

PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: characters after a piece that can still change it ("'" before "re", a blank before a word)
PIECE_AHEAD = 3
#: pieces up to this many bytes are merged in batches and kept
SHORT = 256
CHUNK = 1 << 16
KEPT_PIECES = 150_000
#: texts that are cut into pieces together
BATCH_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable
    Latin-1 for itself, the others counted up from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return table


class PairRanks:
    """Ranks of pairs of ids: an open hash table in arrays, sparse enough that
    a few vector steps find or rule out every pair."""

    def __init__(self, keys: np.ndarray):
        self.none = len(keys)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 1, -1, np.int64)
        self.ranks = np.full((1 << bits) + 1, self.none, np.int64)
        # the first of equal keys has the smaller rank
        todo, rank = np.unique(keys, return_index=True)
        slot, self.probes = self._slot(todo), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.ranks[slot[take]] = todo[take], rank[take]
            todo, rank, slot = todo[~take], rank[~take], (slot[~take] + 1) % (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``none`` for pairs that do not merge."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], self.none)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % (len(self.keys) - 1)
            have = self.keys[slot[open_]]
            hit = have == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (have != -1)]
        return out


class Tables:
    """The merge list and the vocabulary as arrays; a few MB, the same for any corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.key = hashlib.md5(json.dumps(spec["model"]["merges"]).encode()).hexdigest()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        raw = [b""] * size
        for t, i in vocab.items():
            raw[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, i in self.special.items():
            raw[i] = t.encode()
        self.raw = raw
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m)
                 for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs = PairRanks(self.left << 32 | self.right)
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.lookahead = sufficient_lookahead(self.left, self.right, self.made, self.lengths)


def sufficient_lookahead(left, right, made, lengths) -> int:
    """Bytes after a token that can change it, at most.

    ``open_[t]``: the reach of the merges so far that take t as their left
    part.  ``inside[t]``: the reach through the right ends of t while it was
    made.  A merge (a, b) reaches over b and as far as b itself can be
    changed; what takes a right end of t only counts if it comes before the
    merge that uses that end up.
    """
    open_ = np.zeros(len(lengths), np.int64)
    inside = np.zeros(len(lengths), np.int64)
    for a, b, t in zip(left.tolist(), right.tolist(), made.tolist()):
        settled = max(inside[b], open_[b])
        inside[t] = max(inside[t], settled)
        open_[a] = max(open_[a], lengths[b] + settled)
    return int(max(open_.max(initial=0), inside.max(initial=0)))


def merge_long(data: bytes, tables: Tables, ranks: dict) -> list[int]:
    """Merge one piece: always the earliest merge, leftmost first."""
    ids = tables.byte_id[np.frombuffer(data, np.uint8)].tolist()
    n = len(ids)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = nxt[i]
        if j < n:
            r = ranks.get((ids[i], ids[j]))
            if r is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i] = int(tables.made[r])
        ids[j] = -1
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [x for x in ids if x >= 0]


def merge_words(words: list[bytes], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short pieces at once: in each round every piece applies its
    earliest merge at all its places, from the left, without overlap; only
    pairs next to a merge are looked up again.  The ids of all pieces, and
    their number for each."""
    counts = np.zeros(len(words), np.int64)
    lens = np.array([len(w) for w in words], np.int64)
    ids = tables.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    who = np.flatnonzero(lens)
    lens = lens[who]
    never = tables.pairs.none
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    rank = np.full(len(ids), never, np.int64)
    if len(ids):
        rank[:-1] = tables.pairs.of(ids[:-1], ids[1:])
        rank[np.cumsum(lens) - 1] = never
    while len(who):
        starts = np.cumsum(lens) - lens
        best = np.minimum.reduceat(rank, starts)
        done = best == never
        if done.any():
            keep = np.repeat(~done, lens)
            counts[who[done]] = lens[done]
            parts.append((who[done], ids[~keep]))
            ids, rank = ids[keep], rank[keep]
            who, lens, best = who[~done], lens[~done], best[~done]
            if not len(who):
                break
        places = np.flatnonzero(rank == np.repeat(best, lens))
        # in a run of one letter pairs overlap: every other one, from its start
        near = places[1:] == places[:-1] + 1
        if near.any():
            fresh = np.append(True, ~near)
            first = places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            places = places[(places - first) % 2 == 0]
        ends = np.cumsum(lens)
        ids[places] = tables.made[rank[places]]
        keep = np.ones(len(ids), bool)
        keep[places + 1] = False
        word = np.searchsorted(ends, places, side="right")
        lens = lens - np.bincount(word, minlength=len(lens))
        at = np.cumsum(keep)[places] - 1              # where the merged ones stand now
        ids, rank = ids[keep], rank[keep]
        ends = np.cumsum(lens)
        touched = np.concatenate([at, at[at > 0] - 1])
        rank[touched] = never
        inside = touched[touched + 1 < len(ids)]
        rank[inside] = tables.pairs.of(ids[inside], ids[inside + 1])
        rank[ends - 1] = never
    if not parts:
        return np.zeros(0, np.int64), counts
    # back into the order of the pieces
    begin = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), np.int64)
    for who, some in parts:
        n = counts[who]
        flat[np.repeat(begin[who] - (np.cumsum(n) - n), n) + np.arange(len(some))] = some
    return flat, counts


class Known:
    """Pieces with their ids: a number for each piece, and the ids of all in
    one array.  Beyond ``KEPT_PIECES`` those seen in one batch only go."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.batches: Counter = Counter()
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def add(self, pieces: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.begin)
        self.number.update(zip(pieces, range(n, n + len(pieces))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def used(self, pieces) -> None:
        """A batch has these pieces."""
        self.batches.update(pieces)
        if len(self.number) > KEPT_PIECES:
            stay = [p for p in self.number if self.batches[p] > 1][:KEPT_PIECES // 2]
            numbers = np.array([self.number[p] for p in stay], np.int64)
            flat, counts = self.ids_of(numbers)
            # what stays starts over, half as much ahead
            batches = Counter({p: self.batches[p] // 2 for p in stay})
            self.__init__()
            self.add(stay, flat, counts)
            self.batches = batches

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces, one after another, and their number for each."""
        n = self.count[numbers]
        return self.flat[np.repeat(self.begin[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class Encoder:
    """Text in chunks to ids: ``feed`` each chunk, ``finish`` at the end."""

    def __init__(self, tables: Tables):
        import regex
        self.t = tables
        self.known = Known()
        self.ranks = {(a, b): i for i, (a, b) in
                      enumerate(zip(tables.left.tolist(), tables.right.tolist()))}
        self.pieces = regex.compile(PIECES)
        # what may continue a piece of which the first part is already out
        self.more = {k: regex.compile(p) for k, p in
                     (("L", r"\p{L}+"), ("N", r"\p{N}+"), ("S", r"\s+(?!\S)"),
                      ("O", r"[^\s\p{L}\p{N}]+"))}
        self.kind = regex.compile(r" ?(?:(?P<L>\p{L})|(?P<N>\p{N})|(?P<O>[^\s\p{L}\p{N}]))|(?P<S>\s)")
        self.special = (regex.compile("|".join(map(regex.escape, sorted(tables.special, key=len,
                                                                       reverse=True))))
                        if tables.special else None)
        self.special_ahead = max([0, *(len(s) - 1 for s in tables.special)])
        self.reset()

    def reset(self) -> None:
        self.buffer, self.inside, self.tail = "", None, b""

    # -- pieces -------------------------------------------------------------
    def learn(self, pieces) -> None:
        """Merge the unknown short pieces of a batch together."""
        self.known.used(pieces)
        number = self.known.number
        new = [p for p in pieces if p not in number]
        coded = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [i for i, c in enumerate(coded) if len(c) <= SHORT]
        if short:
            self.known.add([new[i] for i in short], *merge_words([coded[i] for i in short], self.t))

    def _long(self, data: bytes, more: bool) -> tuple[list[int], bytes]:
        """Ids of the settled part of a piece, and the bytes not settled yet."""
        window = 4 * self.t.lookahead + 1024
        out: list[int] = []
        at = 0
        while True:
            part = data[at:at + window]
            closed = at + len(part) == len(data) and not more
            ids = merge_long(part, self.t, self.ranks)
            if closed:
                return out + ids, b""
            upto, length = 0, 0
            for i in ids:
                size = int(self.t.lengths[i])
                if length + size > len(part) - self.t.lookahead:
                    break
                length += size
                upto += 1
            out += ids[:upto]
            at += length
            if at + window > len(data) and more or not length:
                return out, data[at:]

    def _piece(self, p: str) -> list[int]:
        number = self.known.number.get(p)
        if number is not None:
            a = self.known.begin[number]
            return self.known.flat[a:a + self.known.count[number]].tolist()
        data = p.encode("utf-8", "surrogatepass")
        return (merge_words([data], self.t)[0].tolist() if len(data) <= SHORT
                else self._long(data, False)[0])

    def _pieces(self, found: list[str]) -> list[int]:
        """Ids of pieces; the known ones in one gather."""
        get = self.known.number.get
        numbers = np.fromiter((get(p, -1) for p in found), np.int64, len(found))
        if len(numbers) and numbers.min() >= 0:
            return self.known.ids_of(numbers)[0].tolist()
        return list(chain.from_iterable(map(self._piece, found)))

    def _segment(self, text: str, closed: bool) -> tuple[list[int], str]:
        """Ids of the settled pieces at the start of ``text``; the rest of it."""
        out: list[int] = []
        at = 0
        if self.inside:
            m = self.more[self.inside].match(text)
            if m is None and not closed and (not text or text.isspace()):
                return out, text
            end = m.end() if m else 0
            if m is not None and not closed and end == len(text):
                # still in the same long piece; a last blank may belong to the next one
                keep = 1 if self.inside == "S" else 0
                ids, self.tail = self._long(self.tail + text[:len(text) - keep].encode(
                    "utf-8", "surrogatepass"), True)
                return ids, text[len(text) - keep:]
            ids, _ = self._long(self.tail + text[:end].encode("utf-8", "surrogatepass"), False)
            out += ids
            self.inside, self.tail, at = None, b"", end
        found = self.pieces.findall(text, at)
        ends = at
        if not closed:
            total = sum(map(len, found))
            while found and at + total > len(text) - PIECE_AHEAD:
                total -= len(found.pop())
        self.learn(set(found))
        out += self._pieces(found)
        rest = text[ends + sum(map(len, found)):]
        if not closed and len(rest) > CHUNK:
            m = self.kind.match(rest)
            self.inside = m.lastgroup
            keep = 1 if self.inside == "S" else 0
            # the last characters may belong to another piece: only the run itself
            run = self.more[self.inside].match(rest, 1 if rest[0] == " " and self.inside != "S" else 0)
            end = min(run.end(), len(rest) - keep)
            ids, self.tail = self._long(rest[:end].encode("utf-8", "surrogatepass"), True)
            out += ids
            rest = rest[end:]
        return out, rest

    # -- the stream -----------------------------------------------------------
    def feed(self, chunk: str, last: bool = False) -> list[int]:
        self.buffer += chunk
        out: list[int] = []
        while self.special:
            m = self.special.search(self.buffer)
            if m is None:
                break
            ids, rest = self._segment(self.buffer[:m.start()], True)
            out += ids
            out.append(self.t.special[m.group()])
            self.buffer, self.inside, self.tail = self.buffer[m.end():], None, b""
        if last:
            ids, _ = self._segment(self.buffer, True)
            self.reset()
            return out + ids
        safe = len(self.buffer) - self.special_ahead
        if safe > 0:
            ids, rest = self._segment(self.buffer[:safe], False)
            out += ids
            self.buffer = rest + self.buffer[safe:]
        return out

    def finish(self) -> list[int]:
        return self.feed("", last=True)

    def encode(self, text: str) -> list[int]:
        """A whole text, in chunks."""
        if len(text) <= CHUNK:
            return self.feed(text, last=True)
        out: list[int] = []
        for i in range(0, len(text), CHUNK):
            out += self.feed(text[i:i + CHUNK])
        return out + self.finish()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many texts; the short ones share the unknown pieces."""
        plain = [len(t) <= CHUNK and not (self.special and self.special.search(t)) for t in texts]
        cut = [self.pieces.findall(t) if p else None for t, p in zip(texts, plain)]
        fresh = set()
        for c in cut:
            if c:
                fresh.update(c)
        self.learn(fresh)
        # a long text learns pieces too, and the table may then start over: it comes last
        number, parts = self.known.number, [None] * len(texts)
        for k, c in enumerate(cut):
            if c is not None:
                try:
                    parts[k] = self.known.ids_of(np.fromiter(map(number.__getitem__, c), np.int64, len(c)))[0]
                except KeyError:                      # a piece too long to be kept
                    parts[k] = np.array(self._pieces(c), np.int32)
        for k, t in enumerate(texts):
            if parts[k] is None:
                parts[k] = np.array(self.encode(t), np.int32)
        counts = np.array([0, *map(len, parts)], np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.cumsum(counts)


class Decoder:
    """Ids in chunks to text."""

    def __init__(self, tables: Tables):
        self.raw = tables.raw
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        n = len(self.raw)
        return self.state.decode(b"".join([self.raw[i] for i in ids if 0 <= i < n]), last)

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


#: per worker process: the encoder with the pieces it knows, by its merge list
_OF_PROCESS: dict = {}


def _encoder(tables: Tables) -> Encoder:
    if tables.key not in _OF_PROCESS:
        _OF_PROCESS.clear()
        _OF_PROCESS[tables.key] = Encoder(tables)
    return _OF_PROCESS[tables.key]


class Codec:
    """``encode`` and ``decode`` as column functions over one tokenizer file."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = spark.sparkContext.broadcast(Tables(path))

    def encode(self, text: Column) -> Column:
        tables = self.tables

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            e = _encoder(tables.value)
            for texts in batches:
                parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
                for some in by_size(texts, BATCH_CHARS):
                    ids, offsets = e.encode_batch([t or "" for t in some])
                    parts.append(ids)
                    ends.append(offsets[1:] + ends[-1][-1])
                yield pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)),
                                               pa.array(np.concatenate(parts)))

        return run(text)

    def decode(self, ids: Column) -> Column:
        tables = self.tables

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            d = Decoder(tables.value)
            for lists in batches:
                flat = lists.values.to_numpy(zero_copy_only=False)
                at = lists.offsets.to_pylist()
                yield pa.array((d.feed(flat[a:b].tolist()) + d.finish() for a, b in zip(at, at[1:])),
                               pa.string(), size=len(lists))

        return run(ids)


    def round_trip(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """The columns ``keep`` of ``df``, the ids of its texts (null: empty)
        and what they decode to, in one pass.  What goes out is cut to about
        BATCH_CHARS of text at a time, so a task holds little of it."""
        from pyspark.sql import types as T
        tables = self.tables
        fields = [df.schema[c] for c in keep]
        kind = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                             T.StructField("decoded", T.StringType())])
        keep = list(keep)

        def run(batches):
            e, d = _encoder(tables.value), Decoder(tables.value)
            for batch in batches:
                at = 0
                for some in by_size(batch.column(text), BATCH_CHARS):
                    ids, ends = e.encode_batch([t or "" for t in some])
                    back = pa.array([d.feed(ids[a:b].tolist()) + d.finish()
                                     for a, b in zip(ends, ends[1:])], pa.string())
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(at, len(some)) for c in keep), lists, back],
                        [*keep, "ids", "decoded"])
                    at += len(some)

        columns = list(dict.fromkeys([*keep, text]))
        return df.select(*columns).mapInArrow(run, kind)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and ids (array of ints); the text stays."""
    codec = Codec(docs.sparkSession, path or default_path())
    return (docs.withColumn("ids", codec.encode(F.coalesce(F.col("text"), F.lit(""))))
            .withColumn("n_tokens", F.size("ids").cast("long")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = Codec(spark, default_path())
    coded = codec.round_trip(documents(spark, sf_dir), keep=("doc_id",))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
                        .alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
