"""Token ids in binary files, in document order.

Ids are ranked by how often the corpus holds them; a rank takes one to four bytes.  The
lengths go to control bytes of their own (four ids each), apart from the data bytes, so
that a block is coded and decoded by table lookups in numpy: a control byte gives the
lengths of its four ranks, and the places of their bytes.

1. Texts are dealt by ranges of doc_id, sorted, and encoded in that order.  A staged row
   holds the ids of one document with its range and its place there; the first row of a
   chunk of texts has the counts of the chunk's ids beside them.
2. The counts are summed (a task sums its own), and the ids ranked; there are as many counts
   as the vocabulary has ids, whatever the corpus.
3. A writer (Python data source) codes blocks of documents into files named after range
   and place, so that the order of names is that of the documents; only files named in a
   manifest that the driver commits are ever read.
4. The reader plans one partition per file.  The manifest's id counts give each its start.

File: ``TKN1``; then blocks of u32 (documents, ids, data bytes), the documents' ids (8
bytes each) and null flags (1 byte each), their numbers of ids (u32), control bytes,
data bytes.  All little-endian.  ``ranks-*.bin`` holds the ids by rank (u32).
"""
from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gatherlens.llm import vocab
from gatherlens.llm.common import chunks, discard, file_system, shared_dir, staged, tidy, utf8

VOCABULARY, END = "word_bpe_49k.json", 2
RANGE_BYTES = 32 << 20    # of text, on average
BLOCK_IDS = 1 << 18       # ids of a block, unless one document has more
ROLL_IDS = 1 << 25        # ids of a file
CHUNK = 1 << 23
REMEMBERED = 1 << 20      # pieces whose ids a worker keeps, from task to task
MAGIC = b"TKN1"

# By control byte: the length of each of its ranks, of all four, and the places of their
# bytes (16; those that a rank does not have are 16, where a block has a zero).
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = LENGTHS.sum(axis=1)
_starts = np.cumsum(LENGTHS, axis=1) - LENGTHS
PLACES = np.where(np.arange(4) < LENGTHS[:, :, None], _starts[:, :, None] + np.arange(4), -1).reshape(256, 16)


def code(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.concatenate([size, np.zeros(-len(size) % 4, np.uint8)]).reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of control and data bytes."""
    control = np.frombuffer(control, np.uint8)
    starts = np.cumsum(TOTALS[control]) - TOTALS[control]
    # What a rank lacks is read from the zero at the end; so is the padding of the last four.
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    at = PLACES[control]
    at = np.where(at < 0, len(data), starts[:, None] + at)
    return raw[np.minimum(at, len(data))].reshape(-1, 4).view("<u4").ravel()[:n]


class Known:
    """Ids of pieces, kept in arrays: Arrow finds the pieces of a chunk among the known ones,
    ``make`` gives the ids (u32) of the others.  Beyond ``most`` pieces the half that was met
    last stays."""

    def __init__(self, make, most: int = REMEMBERED):
        self.make, self.most, self.chunk = make, most, 0
        self.pieces, self.ids = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.sizes = self.met = np.zeros(0, np.int64)

    def of(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each list's end."""
        numbered = lists.flatten().dictionary_encode()
        at = pc.index_in(numbered.dictionary, value_set=self.pieces)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if missing.any():
            new = numbered.dictionary.filter(pa.array(missing))
            ids = self.make([p.decode("utf-8", "replace") for p in new.to_pylist()])
            at[missing] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.uint32)])
            self.sizes = np.concatenate([self.sizes, np.array([len(x) // 4 for x in ids], np.int64)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.chunk += 1
        self.met[at] = self.chunk
        at = at[numbered.indices.to_numpy()]
        starts, own = np.cumsum(self.sizes) - self.sizes, self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        place = np.repeat(starts[at] - ends[:-1], own) + np.arange(ends[-1])
        out = self.ids[place], ends[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        if len(self.pieces) > self.most:
            self._forget()
        return out

    def _forget(self):
        keep = np.zeros(len(self.met), bool)
        keep[np.argsort(-self.met, kind="stable")[:self.most // 2]] = True
        self.pieces, self.ids = self.pieces.filter(pa.array(keep)), self.ids[np.repeat(keep, self.sizes)]
        self.sizes, self.met = self.sizes[keep], self.met[keep]


class Encoder:
    """Ids (u32) of texts.  White space is in no id, so texts are cut into pieces at blanks
    and line ends, and a mark after a word is a piece of its own, as for the tokenizer; each
    distinct piece is encoded once."""

    def __init__(self, source: vocab.Source):
        self.t = vocab.loaded(source)
        rules = json.loads(source.data)
        split = json.dumps(rules["pre_tokenizer"]) + json.dumps(rules["normalizer"])
        suffix = rules["model"].get("end_of_word_suffix")
        # Cuts are those of a vocabulary of lower-case words with marked ends; else whole texts.
        self.words = bool(suffix) and WORD_RULE in split and '"Lowercase"' in split
        self.last = np.zeros(self.t.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.t.get_vocab(with_added_tokens=True).items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.known = Known(self._piece_ids)

    def _piece_ids(self, pieces):
        words = [p for p in pieces if LETTERS.fullmatch(p)]
        out = dict(zip(words, vocab.encode_together(self.t, words, " ", None, self.last)))
        other = [p for p in pieces if p not in out]
        out.update(zip(other, [vocab.packed(e.ids) for e in self.t.encode_batch_fast(other, add_special_tokens=False)]))
        return list(map(out.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's end."""
        if not self.words:
            decoded = [t.decode("utf-8", "replace") for t in utf8(texts)]
            ids = [vocab.packed(e.ids) for e in self.t.encode_batch_fast(decoded, add_special_tokens=False)]
            return np.frombuffer(b"".join(ids), np.uint32), np.cumsum([len(x) // 4 for x in ids])
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        # Names of special tokens are the only thing that lower case changes.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        texts = pc.replace_substring_regex(texts, "([a-zà-öø-ÿ])([.,;:!?]) ", r"\1 \2 ")
        return self.known.of(pc.split_pattern(texts.cast(pa.binary()), b" "))


WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


_ENCODERS: dict = {}


def _encoder(source: vocab.Source) -> Encoder:
    """The encoder of a tokenizer; once per worker, with the pieces that it has met."""
    key = source.key()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


def _encoded(source: vocab.Source, end: int | None):
    tail = b"" if end is None else vocab.packed([end])

    def run(batches):
        encoder = _encoder(source)
        part, place = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "text", CHUNK):
            every, ends = encoder.encode(batch.column("text"))
            found = np.bincount(every, minlength=0 if end is None else end + 1)
            if end is not None:
                found[end] += batch.num_rows
            some = np.flatnonzero(found)
            counts = [np.concatenate([some, found[some]]).astype("<i8").tobytes()] + [None] * (batch.num_rows - 1)
            raw, ends = every.tobytes(), (4 * ends).tolist()
            ids = [raw[a:z] + tail for a, z in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(len(ids), part), pa.int64()),
                 pa.array(np.arange(place, place + len(ids)), pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([narrow(x) for x in ids], pa.binary()), pa.array(counts, pa.binary())],
                names=["id", "part", "place", "n", "ids", "counts"])
            place += len(ids)
    return tidy(run)


def narrow(ids: bytes) -> bytes:
    """u32 ids as their low and high halves, which compress better apart."""
    return np.frombuffer(ids, "<u2").reshape(-1, 2).T.tobytes()


def widen(halves: bytes) -> np.ndarray:
    return np.frombuffer(halves, "<u2").reshape(2, -1).T.copy().view("<u4").ravel()


def _counts(size: int):
    def run(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("counts").drop_null().to_pylist():
                tokens, n = np.frombuffer(x, "<i8").reshape(2, -1)
                sums[tokens] += n
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["token", "n"])
    return tidy(run)


class Files(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class TokenWriter(DataSourceArrowWriter):
    """Codes rows (part, place, id, n, ids) that come in order of place for each part."""

    def __init__(self, path: str, ranks: str):
        self.path, self.ranks = path, ranks

    def write(self, batches):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_input_stream(f"{root}/{self.ranks}") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        self.fs, self.root, self.files, self.out = fs, root, [], None
        held, n_held, at = [], 0, None
        for batch in batches:
            for part, place, key, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "id", "n", "ids"))):
                if at is not None and (part, place) != at:  # another range, or another piece of one
                    self._block(held)
                    self._close()
                    held, n_held = [], 0
                elif held and n_held + n > BLOCK_IDS:
                    self._block(held)
                    held, n_held = [], 0
                if self.out is not None and self.files[-1][2] >= ROLL_IDS:
                    self._close()
                if self.out is None:
                    self._open(part, place)
                held.append((key, rank_of[widen(ids)] if n else np.zeros(0, np.uint32)))
                n_held += n
                at = (part, place + 1)
        self._block(held)
        self._close()
        return Files(self.files)

    def _open(self, part, place):
        # Zeros before the numbers: the order of names is that of the documents.
        name = f"{part:010d}-{place:015d}-{uuid.uuid4().hex}.tok"
        self.out = self.fs.open_output_stream(f"{self.root}/{name}")
        self.out.write(MAGIC)
        self.files.append([name, 0, 0])

    def _block(self, held):
        if not held:
            return
        ranks = np.concatenate([r for _, r in held])
        control, data = code(ranks)
        sizes = np.array([len(r) for _, r in held], "<u4")
        self.out.write(np.array([len(held), len(ranks), len(data)], "<u4").tobytes())
        self.out.write(np.array([k or 0 for k, _ in held], "<i8").tobytes())
        self.out.write(bytes([k is None for k, _ in held]))
        for x in (sizes.tobytes(), control, data):
            self.out.write(x)
        self.files[-1][1] += len(held)
        self.files[-1][2] += len(ranks)

    def _close(self):
        if self.out is not None:
            self.out.close()
        self.out = None

    def commit(self, messages):
        fs, root = file_system(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"ranks": self.ranks, "files": files}).encode())

    def abort(self, messages):
        fs, root = file_system(self.path)
        for m in messages:
            for name, _, _ in (m.files if m is not None else []):
                fs.delete_file(f"{root}/{name}")


class File(InputPartition):
    def __init__(self, name, start, ranks):
        super().__init__(name)
        self.start, self.ranks = start, ranks


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        fs, root = file_system(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())
        out, start = [], 0
        for name, _, ids in manifest["files"]:
            out.append(File(name, start, manifest["ranks"]))
            start += ids
        return out or [File("", 0, "")]

    def read(self, partition):
        if not partition.value:
            return
        fs, root = file_system(self.path)
        with fs.open_input_stream(f"{root}/{partition.ranks}") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        with fs.open_input_stream(f"{root}/{partition.value}") as f:
            yield from blocks(f, partition.start, by_rank)


def blocks(f, start: int, by_rank: np.ndarray):
    """Record batches (doc_id, start, n_tokens, ids) of an open file."""
    if f.read(4) != MAGIC:
        raise ValueError("not a token file")
    while head := f.read(12):
        docs, n, size = np.frombuffer(head, "<u4").tolist()
        keys, null = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(docs), np.uint8)
        sizes = np.frombuffer(f.read(4 * docs), "<u4").astype(np.int64)
        control = f.read(-(-n // 4))
        ids = by_rank[decode(control, f.read(size), n)]
        ends = np.cumsum(sizes)
        raw = pa.py_buffer(np.ascontiguousarray(ids).tobytes())
        offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64(), mask=null.astype(bool)), pa.array(start + ends - sizes, pa.int64()),
             pa.array(sizes, pa.int64()), pa.Array.from_buffers(pa.binary(), docs, [None, offsets, raw])],
            names=["doc_id", "start", "n_tokens", "ids"])
        start += n


class TokenSource(DataSource):
    """``path``: folder of token files; ``ranks``: the name of its table of ids by rank
    (for writing)."""

    @classmethod
    def name(cls):
        return "token_ids"

    def schema(self):
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"], self.options["ranks"])


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text",
          end: int | None = END) -> None:
    """Encode the texts and write their ids to the folder ``path``, which must not hold
    token files yet, in ascending order of ``id_col`` (a whole number).

    Null ids come first; rows that share an id follow each other in the order of the
    input's files.  Null and empty texts have the end id only (nothing, if ``end`` is
    None).  Bytes that are no UTF-8 are replacement characters.  Empty tables give a
    manifest without files.  Other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    source = vocab.read(tokenizer or vocab.public(VOCABULARY))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = int(total) // RANGE_BYTES + 1
    # The place in the input spreads rows of a frequent id, and orders them.
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, "id", "row").sortWithinPartitions("id", "row")
    encoded = staged(rows.select("id", "text").mapInArrow(
        _encoded(source, end), "id long, part long, place long, n long, ids binary, counts binary"), "token-ids")
    size = vocab.loaded(source).get_vocab_size(with_added_tokens=True)
    counted = encoded.select("counts").mapInArrow(_counts(max(size, (end or 0) + 1)), "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n"))
    # At most one row for each id of the vocabulary.
    found = counted.orderBy(F.desc("n"), "token").toPandas()
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    name = f"ranks-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(found["token"].to_numpy().astype("<u4").tobytes())
    encoded.drop("counts").write.format("token_ids").option("path", path).option("ranks", name).mode("append").save()
    discard(encoded)


def read(spark, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of a folder that ``write`` made: ``start`` counts
    the ids of all documents before; ``ids`` are little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_ids").option("path", path).load()


def round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``write`` to a folder (a new one in the shared folder, if none is given), then ``read``."""
    path = path or f"{shared_dir(docs.sparkSession)}/staged/tokens-{uuid.uuid4().hex}"
    write(docs, path, **options)
    return read(docs.sparkSession, path)
