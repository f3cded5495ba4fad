"""Token counts of documents in flat, unindexed token files.

A token file is nothing but little-endian 16-bit token ids, each document
followed by one end-of-document id. `write_token_files` makes such files with a
public byte-level BPE vocabulary; Spark's text writer appends the separator's
two bytes after each row, so each task streams its documents to one file.
`count_tokens` knows nothing but the files, of whatever size:

1. Spark cuts files into byte ranges and deals them out over tasks. It does so
   by lines, and a file of numbers has them too: the byte 0x0A is part of one
   token in a hundred or so. A line says nothing about tokens, but lines of a
   range put together again are the bytes of a block.
2. A block does not know where in the file it begins, only its length. So it
   searches separators at even and at odd bytes, one vectorised comparison each,
   and keeps both lists, and the two bytes at its ends.
3. A prefix scan over the blocks of a file adds up their lengths, which gives
   each block its place and so tells which of its lists counts; a second one
   stitches documents across blocks (separators so far, place of the last one).
   A token of which a block has only half is looked at where the blocks meet.

Beside the token files the writer keeps, under the same part and file number, a
file of document ids in the same order (decimal, then the separator), so that
counts can be given their ids.

Defined results: a null or empty text is a document of 0 tokens; tokens after a
file's last separator are a document without an end, counted last (`ended`
false); a last odd byte of a file is no token; an empty file or table gives no
rows; special tokens' names in a text are ordinary text, so the separator never
occurs within a document; repeated rows are documents of their own; a null
doc_id stays null; other columns are ignored. Ids are 16 bits wide. The three
bytes that Spark's reader takes off a file's begin as a mark (EF BB BF) are
added again. More than 2 GB of a file without any byte 0x0A can't be read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_small_batches, shared_path, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id that this vocabulary leaves free, and its two bytes as latin-1 text.
END = 50256
_SEPARATOR = END.to_bytes(2, "little").decode("latin-1")
#: Bytes of a block at most, but for its last line.
BLOCK = 8 << 20
_MARK = b"\xef\xbb\xbf"
_encoders: dict[int, object] = {}


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The tokenizer of a rank file's content, made once a process."""
    if hash(ranks) not in _encoders:
        import tiktoken

        pieces = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, ranks.splitlines())}
        _encoders[hash(ranks)] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})
    return _encoders[hash(ranks)]


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> None:
    """Writes `path`/kind=tokens and `path`/kind=ids, one flat file a task in each."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))  # a vocabulary's size, whatever the table

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, kinds, values = batch.slice(a, 256), [], []
                for ident, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    kinds += ["tokens", "ids"]
                    values += [np.asarray(tokens.encode_ordinary(value.as_py() or ""), "<u2").tobytes(), b"" if ident is None else str(ident).encode()]
                yield pa.record_batch([pa.array(values, pa.binary()), pa.array(kinds)], names=["value", "kind"])

    rows = in_small_batches(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).mapInArrow(encode, "value binary, kind string")
    # both files of a task stay open, so rows keep their order and need no sort; `rows` has a session of its own
    rows.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")
    rows.select(F.col("value").cast("string").alias("value"), "kind").write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR).text(path)


def _lines(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, size of it, range and bytes of each stretch between separators; the stretches of a range come in the file's order."""
    read = spark.read.option("recursiveFileLookup", "true").option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("line"))


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.Array]]:
    """Runs of lines of one range of a file."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, start = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("range").to_numpy()
        edges = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.column("file")[a].as_py(), batch.column("size")[a].as_py(), int(start[a]), batch.column("line").slice(a, b - a)


def _scan(end: int, most: int):
    """Blocks of the lines of a range: bytes, separators that begin at even and at odd bytes of it, and its first and last byte."""
    low, high = end & 0xFF, end >> 8

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple[str, int], int] = {}
        for file, size, start, lines in _ranges(batches):
            data, offsets = text_bytes(lines)
            # the line ends, which the reader took off, are put back
            whole = np.full(len(data) + len(lines), 10, np.uint8)
            keep = np.ones(len(whole), bool)
            keep[offsets[1:] + np.arange(len(lines))] = False
            whole[keep] = data
            for a in range(0, len(whole), most):
                block = whole[a : a + most]
                at = np.flatnonzero((block[:-1] == low) & (block[1:] == high)).astype(np.int64)
                k = places[file, start] = places.get((file, start), -1) + 1
                yield pa.record_batch(
                    [pa.array([file]), pa.array([size], pa.int64()), pa.array([start], pa.int64()), pa.array([k], pa.int64()), pa.array([len(block)], pa.int64()), *(pa.array([at[at % 2 == odd]], pa.list_(pa.int64())) for odd in (0, 1)), pa.array([int(block[0])]), pa.array([int(block[-1])])],
                    names=["file", "size", "range", "k", "bytes", "even", "odd", "first", "last"],
                )

    return run


def count_tokens(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, doc_no, start, n_tokens, ended of every document of the flat files below `path`, in tokens from the file's begin."""
    schema = "file string, size long, range long, k long, bytes long, even array<long>, odd array<long>, first long, last long"
    blocks = _lines(spark, path, "\n").mapInArrow(_scan(end, block), schema)
    order = Window.partitionBy("file").orderBy("range", "k")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    # every line was given an end, which a file's last line may lack; what is missing on the whole is the mark
    mark = F.when(F.sum("bytes").over(whole) < F.col("size"), F.lit(len(_MARK))).otherwise(0)
    placed = blocks.withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0)) + mark).withColumn("until", F.least(F.col("at") + F.col("bytes"), F.col("size")))
    # a token that begins with the last byte of the block before; the mark ends in the middle of one
    cut = F.when(F.col("at") % 2 == 1, F.coalesce(F.lag("last").over(order), F.lit(_MARK[2])) + 256 * F.col("first") == end).otherwise(False)
    known = placed.withColumn("_marked", (F.col("at") == len(_MARK)) & F.lag("last").over(order).isNull() & F.lit(int.from_bytes(_MARK[:2], "little") == end))
    inside = F.transform(F.when(F.col("at") % 2 == 0, F.col("even")).otherwise(F.col("odd")), lambda x: F.floor((x + F.col("at")) / 2).cast("long"))
    # the end given to a file's last line is no byte of it
    real = F.filter(F.concat(F.when(F.col("_marked"), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")), F.when(cut, F.array(F.floor(F.col("at") / 2).cast("long"))).otherwise(F.array().cast("array<long>")), inside), lambda x: 2 * x + 2 <= F.col("until"))
    found = known.select("file", "range", "k", F.floor(F.col("size") / 2).cast("long").alias("stop"), real.alias("found"))
    last = Window.partitionBy("file").orderBy(F.desc("range"), F.desc("k"))
    stitched = found.select(
        "file",
        F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.array_max("found")).over(before) + 1, F.lit(0)).cast("long").alias("open"),
        "found",
        F.when(F.row_number().over(last) == 1, F.col("stop")).alias("file_stop"),
    )
    # the file's last block also closes what no separator ends
    tail = F.greatest(F.col("open"), F.coalesce(F.array_max("found") + 1, F.lit(0)))
    stops = F.when(F.col("file_stop") > tail, F.concat("found", F.array("file_stop"))).otherwise(F.col("found"))
    docs = stitched.select("file", "docs_before", "open", "found", stops.alias("stops")).select("file", "docs_before", "open", "found", F.posexplode("stops").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.expr("found[k - 1] + 1"))
    return docs.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.size("found")).alias("ended"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_no, doc_id of the id files that `write_token_files` keeps."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple[str, int], int] = {}
        for file, _, start, lines in _ranges(batches):
            ids = [int(x) if x else None for x in lines.to_pylist()]
            k = places[file, start] = places.get((file, start), -1) + 1
            yield pa.record_batch([pa.array([file]), pa.array([start], pa.int64()), pa.array([k], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "range", "k", "ids"])

    parts = _lines(spark, f"{path}/kind=ids", _SEPARATOR).mapInArrow(listed, "file string, range long, k long, ids array<long>")
    before = Window.partitionBy("file").orderBy("range", "k").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select("file", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).alias("before"), "ids")
    placed = placed.select("file", "before", F.posexplode("ids").alias("k", "doc_id"))
    return placed.select("file", (F.col("before") + F.col("k")).alias("doc_no"), "doc_id")


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document, by way of token files in the shared folder."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "tokens")
    if docs.isEmpty():  # there would be no files
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    write_token_files(docs, path, vocabulary)
    # a task may go on to further files; both kinds do so at the same document
    number = F.concat_ws("/", F.regexp_extract("file", r"/part-(\d+)", 1), F.regexp_extract("file", r"[.-]c(\d+)\.", 1))
    counts = count_tokens(spark, f"{path}/kind=tokens").withColumn("part", number)
    ids = read_ids(spark, path).withColumn("part", number).drop("file")
    return counts.join(ids, ["part", "doc_no"]).select("doc_id", "n_tokens")
