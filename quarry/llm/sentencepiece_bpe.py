"""SentencePiece encoding and decoding, with giant documents encoded in parallel.

The vocabulary is a byte-pair model. Its encoding of a text is the only segmentation all of whose neighbouring pieces
are *compatible*: the pair's joint text encodes to that very pair. That makes encoding a shortest-path problem over
(position, last piece) with weights 0 (compatible) and minus infinity, in the max-plus semiring. A giant document is
cut into chunks at fixed places. Each chunk yields a transfer matrix from the pieces that may straddle its left edge
to those that may straddle its right edge; the matrices are combined associatively; then each chunk traces its own
pieces back from the two states that the combination fixed.
"""

from __future__ import annotations

import re
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, small_batches, text_or_empty, unused_name

#: Code points of a chunk; longer documents are encoded in chunks.
CHUNK_CHARS = 32_768
SPACE = "▁"
#: A run of spaces and what follows it up to the next one. No piece spans the start of such a unit.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct units a worker remembers, the code points of the longest of them, and texts it splits into units at a time.
_CACHE = 100_000
_LONGEST = 64
GROUP = 32
#: A state: the piece at a place, or None before the first, and the position where it ends.
State = tuple[int | None, int]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, wire type, whole field) of each field of a serialised message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            _, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            at += size
        else:
            at += {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, tag & 7, data[start:at]


def without_prefix(model: bytes) -> bytes:
    """The model with ``add_dummy_prefix`` switched off, so that parts of a text can be encoded by themselves."""

    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, kind, raw in _fields(model):
        if field == 3 and kind == 2:  # normalizer_spec
            _, at = _varint(raw, 0)
            _, at = _varint(raw, at)
            body = b"".join(r for f, _, r in _fields(raw[at:]) if f != 3) + b"\x18\x00"  # add_dummy_prefix = false
            raw = b"\x1a" + number(len(body)) + body
        out += raw
    return out


class Bpe:
    """A byte-pair model with byte fallback and an identity normaliser."""

    def __init__(self, model_file: str | None = None, model: bytes | None = None):
        model = model if model is not None else open(model_file, "rb").read()
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=without_prefix(model))
        size = self.raw.get_piece_size()
        self.pieces = [self.raw.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (self.raw.is_control(i) or self.raw.is_unknown(i) or self.raw.is_byte(i))}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece spans the end of a word")
        self.longest = max(map(len, self.ids))
        byte = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if self.raw.is_byte(i)}
        self.byte_ids = {b: i for i, b in byte.items()}
        self.bytes = [bytes([byte[i]]) if i in byte else b"" if self.raw.is_control(i) or self.raw.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.cache: dict[str, bytes] = {}
        self.compatible = lru_cache(1 << 18)(self._compatible)

    # -- plain encoding ------------------------------------------------------------------------------------------

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each normalised text, unit by unit, each distinct unit once."""
        units = [_UNIT.findall(t) for t in texts]
        new = list({u for x in units for u in x} - self.cache.keys())
        if len(self.cache) + len(new) > _CACHE:
            self.cache.clear()
            new = list({u for x in units for u in x})
        fresh = {u: np.asarray(ids, "<i4").tobytes() for u, ids in zip(new, self.raw.encode(new, num_threads=1) if new else [], strict=True)}
        self.cache.update((u, ids) for u, ids in fresh.items() if len(u) <= _LONGEST)
        found = ChainMap(self.cache, fresh) if any(len(u) > _LONGEST for u in fresh) else self.cache
        return [np.frombuffer(b"".join(map(found.__getitem__, x)), "<i4") for x in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first goes."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")

    # -- max-plus scan -------------------------------------------------------------------------------------------

    def _spell(self, key: int) -> str:
        return self.pieces[key] if key >= 0 else chr(-1 - key)

    def _emit(self, key: int) -> list[int]:
        return [key] if key >= 0 else [self.byte_ids[b] for b in chr(-1 - key).encode()]

    def _compatible(self, left: int | None, right: int) -> bool:
        """Whether the two pieces may stand side by side. Negative keys are characters outside the vocabulary."""
        if left is None:
            return right < 0 or list(self.raw.encode(self._spell(right))) == [right]
        if left < 0 or right < 0:
            return self._compatible(None, right if left < 0 else left) if left >= 0 or right >= 0 else True
        return list(self.raw.encode(self.pieces[left] + self.pieces[right])) == [left, right]

    def _ending(self, text: str, end: int, least: int) -> Iterator[tuple[int, int]]:
        """(start, key) of the pieces that end at ``end`` and start at ``least`` or later."""
        for start in range(max(least, end - self.longest), end):
            key = self.ids.get(text[start:end])
            if key is not None:
                yield start, key
            elif start == end - 1:
                yield start, -1 - ord(text[start])

    def straddling(self, text: str, cut: int) -> list[State]:
        """The pieces that may hold the character before ``cut``; the text reaches ``longest`` characters to each side."""
        return [(key, end) for end in range(cut, min(len(text), cut + self.longest) + 1) for start, key in self._ending(text, end, 0) if start < cut]

    def reach(self, text: str, state: State, to: int) -> dict[int, tuple[int, int | None]]:
        """position -> (start, key) of the last piece, for each position that compatible pieces reach from ``state``.

        Pieces start before ``to``, so those that end past it straddle it. From one state at most one piece leads to a
        position: the last of the encoding of the text up to there.
        """
        first, at = state
        last: dict[int, tuple[int, int | None]] = {at: (-1, first)}
        for end in range(at + 1, min(len(text), to + self.longest) + 1):
            for start, key in self._ending(text, end, at):
                if start in last and start < to and self.compatible(last[start][1], key):
                    last[end] = (start, key)
                    break
        return last

    def _joints(self, text: str, left: int, right: int) -> tuple[int, int] | None:
        """The first and the last place of left..right where a unit starts; every encoding has a piece starting there."""
        found = [i for i in (self._joint_after(text, left, right), self._joint_before(text, left, right)) if i is not None]
        return (found[0], found[-1]) if found else None

    @staticmethod
    def is_joint(text: str, at: int) -> bool:
        return at == 0 or at < len(text) and text[at] == SPACE and text[at - 1] != SPACE

    def _joint_after(self, text: str, left: int, right: int) -> int | None:
        return next((i for i in range(left, right + 1) if self.is_joint(text, i)), None)

    def _joint_before(self, text: str, left: int, right: int) -> int | None:
        return next((i for i in range(right, left - 1, -1) if self.is_joint(text, i)), None)

    def states(self, text: str, cut: int, final: bool) -> list[State]:
        """What may stand at an edge: nothing pending at a joint or the end of the document, else a straddling piece."""
        return [(None, cut)] if final or self.is_joint(text, cut) else self.straddling(text, cut)

    def _arrives(self, text: str, state: State, out: State, to: int) -> bool:
        last = self.reach(text, state, to)
        return out[1] in last and (out[0] is None or last[out[1]][1] == out[0]) and (out[0] is None or out[1] != state[1])

    def transfer(self, text: str, left: int, right: int, final: bool) -> tuple[list[State], list[State], np.ndarray]:
        """States at both edges of the chunk text[left:right] and the matrix of path weights, 0 or minus infinity."""
        ins, outs = self.states(text, left, False), self.states(text, right, final)
        joints = self._joints(text, left, right)
        if joints is None:
            weights = [[0.0 if self._arrives(text, i, o, right) else -np.inf for o in outs] for i in ins]
            return ins, outs, np.array(weights)
        head = np.array([0.0 if self._arrives(text, i, (None, joints[0]), joints[0]) else -np.inf for i in ins])
        tail = np.array([0.0 if self._arrives(text, (None, joints[1]), o, right) else -np.inf for o in outs])
        return ins, outs, head[:, None] + tail[None, :]

    def _walk(self, text: str, state: State, out: State, to: int) -> list[int]:
        last, at, keys = self.reach(text, state, to), out[1], []
        while at != state[1]:
            at, key = last[at]
            keys.append(key)
        return [i for key in reversed(keys) for i in self._emit(key)]

    def trace(self, text: str, left: int, right: int, state: State, out: State) -> np.ndarray:
        """The ids of the chunk's pieces, after the piece of ``state`` and up to that of ``out``."""
        joints = self._joints(text, left, right)
        if joints is None:
            return np.array(self._walk(text, state, out, right), "<i4")
        head = self._walk(text, state, (None, joints[0]), joints[0])
        tail = self._walk(text, (None, joints[1]), out, right)
        return np.concatenate([np.array(head, "<i4"), self.encode_many([text[joints[0] : joints[1]]])[0], np.array(tail, "<i4")]).astype("<i4")


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The associative product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def settle(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states (in, out) of each chunk on the best path through all of them.

    Products of prefixes and of suffixes tell, for every edge, the weight of the best whole path through each state.
    """
    ahead, back = [np.zeros((1, matrices[0].shape[0]))], [np.zeros((matrices[-1].shape[1], 1))]
    for m in matrices:
        ahead.append(max_plus(ahead[-1], m))
    for m in reversed(matrices):
        back.append(max_plus(m, back[-1]))
    at = [int(np.argmax(a[0] + b[:, 0])) for a, b in zip(ahead, reversed(back), strict=True)]
    return list(zip(at[:-1], at[1:], strict=True))


_models: dict[bytes, Bpe] = {}


def _model(proto: bytes) -> Bpe:
    """One model, with its cache of units, for each worker process."""
    key = proto[-64:] + len(proto).to_bytes(8, "little")
    if key not in _models:
        _models.clear()
        _models[key] = Bpe(model=proto)
    return _models[key]


DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def encode(docs: DataFrame, carry: list[str] | None = None, model_file: str = DEFAULT_MODEL, chunk_chars: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """The columns ``carry`` (doc_id, text) of each row with ids (little-endian 32-bit numbers in one binary) and n_chunks;
    with ``decoded``, what ``decode`` gives for the ids as well, by the worker that has them.

    The ids are those of the plain encoder, whatever the chunks. A null or empty text has no ids and no chunk. Repeated
    rows are each encoded; an empty table gives no rows. Carried columns called ids or n_chunks are an error. The model
    file is read once, by the driver.
    """
    carry = carry or ["doc_id", "text"]
    if {c.lower() for c in carry} & {"ids", "n_chunks", "decoded"}:
        raise ValueError("the columns ids, n_chunks and decoded are results")
    spark = docs.sparkSession
    small_batches(spark)
    proto = spark.sparkContext.broadcast(open(model_file, "rb").read())
    name = unused_name("encoded_text", docs.columns)
    rows = docs.select(*carry, text_or_empty().alias(name))
    shape = rows.drop(name).withColumn("ids", F.lit(b"")).withColumn("n_chunks", F.lit(0))
    schema = (shape.withColumn("decoded", F.lit("")) if decoded else shape).schema

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(proto.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [x for at in range(0, len(texts), GROUP) for x in bpe.encode_many([bpe.normal(t) for t in texts[at : at + GROUP]])]
            columns = [pa.array([x.tobytes() for x in found], pa.binary()), pa.array([int(bool(t)) for t in texts], pa.int32())]
            if decoded:
                columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    short = rows.filter(F.length(name) <= chunk_chars).mapInArrow(plain, schema)
    giant = rows.filter(F.length(name) > chunk_chars)
    row = unused_name("encoded_row", docs.columns)
    giant = materialize(giant.withColumn(row, F.monotonically_increasing_id()), "giant")
    ids = encode_giants(giant.select(F.col(row).alias("row"), F.col(name).alias("text")), proto, chunk_chars)
    long = giant.drop(name).join(ids.withColumnRenamed("row", row), row).select(*carry, "ids", "n_chunks")
    return short.unionByName(decode(long, model_file) if decoded else long)


def encode_giants(texts: DataFrame, proto, chunk_chars: int) -> DataFrame:
    """row, ids, n_chunks from (row, text) by the max-plus scan over chunks."""
    margin = _model(proto.value).longest
    whole = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    # One pass cuts a text; each chunk then takes its margins from its neighbours.
    cuts = texts.select("row", F.regexp_extract_all(whole, F.lit("(?s).{1,%d}" % chunk_chars), F.lit(0)).alias("cuts"))

    def chunk(text: Column, i: Column, cuts: Column) -> Column:
        before = F.when(i > 0, F.substring(F.get(cuts, i - 1), -margin, margin)).otherwise(F.lit(""))
        after = F.coalesce(F.substring(F.get(cuts, i + 1), 1, margin + 1), F.lit(""))
        left = F.length(before)
        return F.struct(F.concat(before, text, after).alias("text"), left.alias("left"), (left + F.length(text)).alias("right"), (i == F.size(cuts) - 1).alias("final"))

    chunks = F.posexplode(let(F.col("cuts"), lambda all_: F.transform(all_, lambda t, i: chunk(t, i, all_))))
    parts = materialize(cuts.select("row", chunks.alias("chunk", "c")).select("row", "chunk", "c.*"), "chunks")

    def edges(bpe: Bpe, text: str, left: int, right: int, final: bool) -> tuple[list[State], list[State], np.ndarray]:
        # The margin before a chunk that starts within a document is not the start of a document.
        return bpe.transfer(text, left, right, final)

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(proto.value)
        for batch in batches:
            found = [edges(bpe, *x)[2] for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([(m == 0).tobytes() for m in found], pa.binary())], names=["row", "chunk", "states", "open"])

    def combine(key, f):
        f = f.sort_values("chunk")
        maps = [np.where(np.frombuffer(o, bool).reshape(s, -1), 0.0, -np.inf) for s, o in zip(f["states"], f["open"], strict=True)]
        found = settle(maps)
        return f[["row", "chunk"]].assign(came=[a for a, _ in found], goes=[b for _, b in found])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(proto.value)
        for batch in batches:
            out = []
            for text, left, right, final, came, goes in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                ins, outs = bpe.states(text, left, False), bpe.states(text, right, final)
                out.append(bpe.trace(text, left, right, ins[came], outs[goes]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["row", "chunk", "ids"])

    # One small row for each chunk: its matrix has a few dozen states on either side.
    settled = parts.mapInArrow(transfers, "row long, chunk int, states int, open binary").groupBy("row").applyInPandas(combine, "row long, chunk int, came int, goes int")
    traced = parts.join(settled, ["row", "chunk"]).select("row", "chunk", "text", "left", "right", "final", "came", "goes").mapInArrow(traces, "row long, chunk int, ids binary")
    joined = F.expr("concat_ws('', transform(array_sort(collect_list(struct(chunk, hex(ids)))), x -> x.col2))")
    return traced.groupBy("row").agg(F.unhex(joined).alias("ids"), F.count(F.lit(1)).cast("int").alias("n_chunks"))


def decode(encoded: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids give null, no ids the empty text, no rows none.

    The text is the encoded one exactly, but that U+2581 becomes a space, as the format has it.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    proto = spark.sparkContext.broadcast(open(model_file, "rb").read())
    at = encoded.columns.index("ids")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(proto.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.frombuffer(x, "<i4")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(back, encoded.withColumn("decoded", F.lit("")).schema)


def report(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, n_chunks, ids_sha256, decoded_sha256, round_trip of every row.

    Null texts count as empty and have no tokens; null and repeated ids are reported as they come; no rows give none.
    """
    rows = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), model_file=model_file, decoded=True)
    same = F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "n_chunks", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))
