"""Operator 1, token ids in binary files: a static range asymmetric numeral system.

Texts are dealt by ascending ``doc_id`` into parts and tokenized there; each part
writes its raw ids to the shared folder and counts them. The counts of all parts
make one shared frequency table (its size is the vocabulary's). Every part then
encodes its ids in independent blocks of whole documents. A block interleaves
up to 1024 coder states over one stream of 32-bit words, so that coding is array
work, and keeps checkpoints (all states and the place in the stream) that cut it
into stretches. A stretch has checksums of its own words and ids, is read without
the rest of the block, and is decoded by whichever task it is dealt to; the
checksums of a document that runs over stretches are joined afterwards.

Files get a new name for each attempt and are listed in what the task returns,
so a task that runs twice leaves one listed file.

File: blocks one after another, each a header ``BLOCK`` of little-endian fields,
its stretches (``STRETCH`` and the states there), the document lengths, and its words.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestride.llm.common import Scratch, pick, table

#: Frequencies of the shared table sum to 2 ** SCALE.
SCALE = 20
LANES = 1024
BLOCK_IDS = 1 << 20
CHECKPOINT_STEPS = 512
#: The lower bound of a coder state; states stay under 2 ** 63.
LOW = 1 << 31
#: magic, ids, documents, lanes, stretches, words, crc32 of the document lengths
BLOCK = struct.Struct("<4sQQIIQI")
#: place of its first word in the block, crc32 of its words, crc32 of its ids
STRETCH = struct.Struct("<QII")
MAGIC = b"RNS2"
END = 0
VOCABULARY = "byte_bpe_50k.json"


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum to ``2 ** scale``, at least 1 wherever the count is."""
    used = np.flatnonzero(counts)
    if not len(used):
        raise ValueError("no ids to count")
    if len(used) > 1 << (scale - 1):
        raise ValueError("too many different ids for the scale")
    out = np.zeros(len(counts), dtype=np.int64)
    total = counts.sum(dtype=np.float64)
    out[used] = np.maximum(1, np.floor(counts[used] / total * (1 << scale)).astype(np.int64))
    off = (1 << scale) - int(out.sum())
    order = used[np.argsort(-out[used], kind="stable")]
    while off:
        # what rounding left over goes to, or comes from, the most frequent ids
        for i in order:
            step = off if off > 0 else -min(-off, int(out[i]) - max(1, int(out[i]) // 2))
            out[i] += step
            off -= step
            if not off:
                break
    return out


class Coder:
    """Encodes and decodes blocks under one shared table of frequencies."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.limit = self.freq << np.uint64(63 - scale)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray, lengths: list[int]) -> bytes:
        """One block: ``ids`` of whole documents, whose ``lengths`` add up to it."""
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        words = 0
        for s in range(steps - 1, -1, -1):
            x = ids[s * lanes : (s + 1) * lanes]
            own = state[: len(x)]
            full = own >= self.limit[x]
            if full.any():
                spill = own[full]
                out.append((spill & np.uint64(0xFFFFFFFF)).astype("<u4"))
                words += len(spill)
                own[full] = spill >> np.uint64(32)
            f = self.freq[x]
            q = own // f
            state[: len(x)] = (q << self.scale) + (own - q * f) + self.base[x]
            if s and s % CHECKPOINT_STEPS == 0:
                marks.append((words, state.copy()))
        stream = np.concatenate(out[::-1]) if out else np.zeros(0, dtype="<u4")
        starts = [(0, state), *((words - w, at) for w, at in marks[::-1])]
        ends = [place for place, _ in starts[1:]] + [words]
        size = CHECKPOINT_STEPS * lanes
        points = [
            STRETCH.pack(place, zlib.crc32(stream[place:end].tobytes()), zlib.crc32(ids[k * size : (k + 1) * size].astype("<u4").tobytes())) + at.astype("<u8").tobytes()
            for k, ((place, at), end) in enumerate(zip(starts, ends, strict=True))]
        told = np.asarray(lengths, dtype="<u8").tobytes()
        head = BLOCK.pack(MAGIC, n, len(lengths), lanes, len(points), words, zlib.crc32(told))
        return b"".join([head, *points, told, stream.tobytes()])

    def decode_steps(self, n: int, lanes: int, first: int, upto: int, state: np.ndarray, words: np.ndarray, at: int) -> np.ndarray:
        """Ids of the steps ``first`` to ``upto`` of a block, from the states and the place in its words there."""
        out = np.empty(max(0, min(n, upto * lanes) - first * lanes), dtype=np.uint32)
        state = state.copy()
        for s in range(first, upto):
            k = min(lanes, n - s * lanes)
            own = state[:k]
            slot = own & self.mask
            x = self.symbol[slot]
            out[(s - first) * lanes : (s - first) * lanes + k] = x
            own = self.freq[x] * (own >> self.scale) + slot - self.base[x]
            low = np.flatnonzero(own < LOW)
            if len(low):
                own[low] = (own[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
            state[:k] = own
        return out


class Block:
    """A block of a file, of which ``read(at, size)`` gives bytes; only what is asked for is read."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.n, self.docs, self.lanes, self.stretches, self.words, self.lengths_crc = BLOCK.unpack(read(0, BLOCK.size))
        if magic != MAGIC:
            raise ValueError("not a block")
        self.entry = STRETCH.size + 8 * self.lanes
        self.at_lengths = BLOCK.size + self.stretches * self.entry
        self.at_words = self.at_lengths + 8 * self.docs

    def lengths(self) -> np.ndarray:
        """Ids of each document."""
        told = self.read(self.at_lengths, 8 * self.docs)
        if zlib.crc32(told) != self.lengths_crc:
            raise ValueError("the lengths of a block don't match their checksum")
        return np.frombuffer(told, dtype="<u8").astype(np.int64)

    def stretch(self, coder: Coder, k: int) -> tuple[int, np.ndarray]:
        """The place of stretch ``k`` among the block's ids, and its ids."""
        at = BLOCK.size + k * self.entry
        own = self.read(at, self.entry)
        place, words_crc, ids_crc = STRETCH.unpack_from(own)
        end = STRETCH.unpack(self.read(at + self.entry, STRETCH.size))[0] if k + 1 < self.stretches else self.words
        body = self.read(self.at_words + 4 * place, 4 * (end - place))
        if zlib.crc32(body) != words_crc:
            raise ValueError("the words of a stretch don't match their checksum")
        state = np.frombuffer(own, dtype="<u8", offset=STRETCH.size)
        first = k * CHECKPOINT_STEPS
        upto = min(first + CHECKPOINT_STEPS, -(-self.n // self.lanes))
        ids = coder.decode_steps(self.n, self.lanes, first, upto, state, np.frombuffer(body, dtype="<u4"), 0).astype("<u4")
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("the ids of a stretch don't match their checksum")
        return first * self.lanes, ids


def stretches_of(block: bytes) -> int:
    return BLOCK.unpack_from(block)[4]


#: The polynomial of crc32, lowest power in the highest bit.
CRC_POLYNOMIAL = 0xEDB88320


def crc_times(a: int, b: int) -> int:
    """The product of two polynomials over bits, as remainders of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def crc_join(first: int, second: int, size: int) -> int:
    """crc32 of two runs of bytes in a row from those of each; ``size`` bytes are in the second."""
    power, out = 1 << 23, first  # x to the 8th: a step of one byte
    while size:
        if size & 1:
            out = crc_times(out, power)
        power, size = crc_times(power, power), size >> 1
    return out ^ second


def storage(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)


def byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def cuts_at_spaces(told: dict) -> bool:
    """Whether a tokenizer's description is that of plain byte-level pair merges, which ``Tokens`` may cut at spaces and classes."""
    before, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return bool(model.get("type") == "BPE" and plain and cuts and not told.get("normalizer") and not told.get("truncation") and not told.get("padding"))


class Tokens(dict):
    """Ids of pieces of text as bytes, remembered up to a number of pieces.

    A piece is a run of letters, digits or signs with the space before it, or a
    run of white space: it begins and ends where the tokenizer's own
    pre-tokenization splits, so the ids of the pieces in turn are those of the
    text. Runs beside a character of no listed class, and all of a text with an
    apostrophe, are cut at white space alone; texts with separators that Python
    and the tokenizer class differently, and texts with an added token's content
    (``<|endoftext|>``), go whole. So do all texts of a tokenizer whose file says
    that it works otherwise (``cuts_at_spaces``).
    """

    SPACE = r"[\s\x1c-\x1f\x85]"
    GAPS = rf"{SPACE}+(?!\S)|{SPACE}+"
    COARSE = rf" ?\S+|{GAPS}"
    L, P, D = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~", "0-9"
    FINE = rf" ?[{L}]++(?=[\s{P}{D}]|\Z)| ?[{P}]++(?=[\s{L}{D}]|\Z)| ?[{D}]++(?=[\s{L}{P}]|\Z)|{COARSE}"

    def __init__(self, path: str, width: str, memory: int = 1_500_000):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width, self.memory = width, memory
        self.pieces = cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.fine = re.compile(self.FINE).findall
        self.coarse = re.compile(self.COARSE).findall
        # one run of letters, digits or signs is one unit of the tokenizer: its model alone gives the ids
        self.single = re.compile(rf" ?(?:[{self.L}]+|[{self.P}]+|[{self.D}]+)").fullmatch
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.space = chr(self.signs[32])
        self.codes = [i.to_bytes(np.dtype(width).itemsize, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memory:
            self.clear()
        core = piece[1:] if piece[0] == " " else piece
        if core.isascii() and core.isalpha():
            unit = self.space + core if core is not piece else piece
        elif self.single(piece):
            unit = piece.encode().decode("latin-1").translate(self.signs)
        else:
            out = self[piece] = self.whole(piece)
            return out
        codes = self.codes
        out = self[piece] = b"".join([codes[t.id] for t in self.model.tokenize(unit)])
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.pieces or any(c in text for c in "\x1c\x1d\x1e\x1f\x85") or any(a in text for a in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.coarse(text) if "'" in text else self.fine(text)))


_tokens: dict[tuple[str, str], Tokens] = {}


def vocabulary(path: str) -> tuple[int, str]:
    """Number of ids and the width in which raw ids are kept."""
    from tokenizers import Tokenizer

    n = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), END + 1)
    return n, "<u2" if n <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, where: str, path: str, parts: int) -> DataFrame:
    """Tokenize ``docs`` (``doc_id, text``) in ascending order of doc_id into raw files, one for each part.

    Rows: ``part, file, id, n``: each part's file (``id`` null, ``n`` ids in all) and its counts by id.
    Null text counts as empty; null ids come first; equal ids follow each other in the order of a hash of their text.
    """
    size, width = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = _tokens.get((path, width)) or _tokens.setdefault((path, width), Tokens(path, width))
        name = f"{where}/raw-{part:06d}-{uuid.uuid4().hex}.zst"
        fs, inner = storage(name)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        counts = np.zeros(size, dtype=np.int64)
        end = np.array([END], dtype=width).tobytes()
        with fs.open_output_stream(inner, compression=None) as raw, zstandard.ZstdCompressor(level=1).stream_writer(raw, closefd=False) as out:
            for b in batches:
                held = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = tokens.encode(t or "") + end
                    held.append(ids)
                    out.write(struct.pack("<?qQ", i is None, i or 0, len(ids)) + ids)
                counts += np.bincount(np.frombuffer(b"".join(held), dtype=width), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array([part] * (len(used) + 1), pa.int32()), pa.array([name] + [None] * len(used), pa.string()), pa.array([None, *used.tolist()], pa.int32()),
            pa.array([int(counts.sum()), *counts[used].tolist()], pa.int64())], ["part", "file", "id", "n"])

    # equal rows may stand in any order, so a number of the row spreads many of them over tasks
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("salt")).repartitionByRange(parts, "doc_id", "h", "salt").sortWithinPartitions("doc_id", "h")
    return ordered.select("doc_id", "text").mapInArrow(run, "part int, file string, id int, n long")


def read_raw(name: str, width: str) -> Iterator[tuple[int | None, np.ndarray]]:
    fs, inner = storage(name)
    head = struct.Struct("<?qQ")
    with fs.open_input_stream(inner, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_size=1 << 20) as stream:

        def exactly(n: int) -> bytes:
            got = []
            while n and (x := stream.read(n)):
                got.append(x)
                n -= len(x)
            return b"".join(got)

        while h := exactly(head.size):
            none, i, n = head.unpack(h)
            yield (None if none else i), np.frombuffer(exactly(n), dtype=width)


def write_blocks(files: DataFrame, where: str, freq: np.ndarray, width: str) -> DataFrame:
    """Encode each raw file (``part, file``) to a file of blocks. Rows, one for each block:
    ``part, file, at, stretches, n_ids, before`` (ids of the part ahead of it) and ``doc_ids`` in order.
    """
    shared = files.sparkSession.sparkContext.broadcast(freq)
    schema = "part int, file string, at long, stretches int, n_ids long, before long, doc_ids array<long>"
    kind = pa.schema([("part", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("stretches", pa.int32()), ("n_ids", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{where}/part-{part:06d}-{uuid.uuid4().hex}.rans"
                fs, inner = storage(name)
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                rows, place, before, total = [], 0, 0, 0
                docs: list[int | None] = []
                held: list[np.ndarray] = []
                with fs.open_output_stream(inner, compression=None) as out:

                    def close() -> None:
                        nonlocal place, before, total
                        block = coder.encode(np.concatenate(held), [len(x) for x in held])
                        out.write(block)
                        rows.append({"part": part, "file": name, "at": place, "stretches": stretches_of(block), "n_ids": total, "before": before, "doc_ids": list(docs)})
                        place, before, total = place + len(block), before + total, 0
                        docs.clear()
                        held.clear()

                    for i, ids in read_raw(raw, width):
                        docs.append(i)
                        held.append(ids)
                        total += len(ids)
                        if total >= BLOCK_IDS:
                            close()
                    if held:
                        close()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    # a task for each file: the list is small, so its ranges hold one part each
    n = max(1, files.count())
    return files.select("part", "file").repartitionByRange(n, "part").mapInArrow(run, schema)


def read_stretches(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """Decode blocks back, each stretch by itself: rows ``part, doc_id, before, n_tokens, at, n, crc``.

    A row is what a stretch holds of a document: ``n`` ids from the ``at``-th on and their checksum.
    ``before`` counts the part's ids ahead of the document.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(freq)
    names = ["part", "doc_id", "before", "n_tokens", "at", "n", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                fs, inner = storage(r["file"].as_py())
                start = r["at"].as_py()
                with fs.open_input_file(inner) as f:
                    block = Block(lambda at, size, f=f, start=start: f.read_at(size, start + at))
                    place, ids = block.stretch(coder, r["stretch"].as_py())
                    lengths = block.lengths()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                # the documents that have an id here
                own = slice(int(np.searchsorted(ends, place, "right")), int(np.searchsorted(begins, place + len(ids), "left")))
                begins, ends = begins[own], ends[own]
                low, high = np.maximum(begins, place), np.minimum(ends, place + len(ids))
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip((low - place).tolist(), (high - place).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["part"].as_py()] * len(crc), pa.int32()), r["doc_ids"].values[own].cast(pa.int64()), pa.array(begins + r["before"].as_py(), pa.int64()),
                    pa.array(lengths[own], pa.int64()), pa.array(low - begins, pa.int64()), pa.array(high - low, pa.int64()), pa.array(crc, pa.int64())], names)

    apart = blocks.select("part", "file", "at", "before", "doc_ids", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"))
    total = blocks.agg(F.sum("stretches")).first()[0] or 1
    # rows are few and heavy: dealt out in turn, by a number that the adaptive plan leaves as it is
    tasks = min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.rdd.getNumPartitions()))
    return apart.repartition(tasks).mapInArrow(run, "part int, doc_id long, before long, n_tokens long, at long, n long, crc long")


def join_stretches(found: DataFrame) -> DataFrame:
    """``part, doc_id, before, n_tokens, ids_crc32`` of each document from the saved rows of ``read_stretches``.

    Most documents lie in one stretch; of the others, two a stretch at most, the checksums are joined.
    """
    @F.pandas_udf("long")
    def joined(runs: pd.Series) -> pd.Series:
        def one(row) -> int:
            crc, done = 0, 0
            for r in row:
                if r["at"] != done:
                    raise ValueError("a stretch of a document is missing")
                crc, done = crc_join(crc, r["crc"], 4 * r["n"]), done + r["n"]
            return crc

        return runs.map(one)

    here = F.col("n") == F.col("n_tokens")
    runs = found.filter(~here).groupBy("part", "doc_id", "before", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("runs"))
    names = ["part", "doc_id", "before", "n_tokens"]
    return found.filter(here).select(*names, F.col("crc").alias("ids_crc32")).unionByName(runs.select(*names, joined("runs").alias("ids_crc32")))


def encode_table(docs: DataFrame, scratch: Scratch, path: str, parts: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Write ``docs`` (``doc_id, text``) as rANS files; returns the saved list of blocks and the shared table.

    There are as many parts as shuffle partitions, or as the table's own if those
    are more. Only the counts, one for each id of the vocabulary, reach the driver.
    """
    spark = docs.sparkSession
    size, width = vocabulary(path)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    told = scratch.save(write_tokens(docs, scratch.path("raw"), path, parts))
    counts = np.zeros(size, dtype=np.int64)
    for r in told.filter("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    counts[END] = max(counts[END], 1)
    freq = frequencies(counts)
    blocks = scratch.save(write_blocks(told.filter("file IS NOT NULL AND n > 0"), scratch.path("rans"), freq, width))
    scratch.remove(scratch.path("raw"))
    return blocks, freq


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, read the files back and tell each document's place, length and checksum.

    Null and empty texts have the end id alone; a very long text is a block of
    its own, read back by a task for each stretch; null ids come first; ties of ids follow each other by a hash of their
    texts; repeated rows each have a place; an empty table gives none; further
    columns don't matter.
    """
    import public_tokenizers

    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    scratch = Scratch(spark, "op1")
    blocks, freq = encode_table(docs, scratch, public_tokenizers.path(VOCABULARY))
    # one row for each part: its place among all ids
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    firsts = np.concatenate([[0], np.cumsum([r["n"] for r in sums], dtype=np.int64)]).tolist()
    starts = spark.createDataFrame([(r["part"], firsts[i]) for i, r in enumerate(sums)], "p int, first long")
    back = join_stretches(scratch.save(read_stretches(blocks, freq)))
    return back.join(F.broadcast(starts), F.col("part") == F.col("p")).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
