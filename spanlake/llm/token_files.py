"""Token ids in flat unsigned integer files with 64-bit document offsets.

A folder holds for each partition, numbered in key order:

* ``part-N-T.bin``  the ids of its documents, end to end, as unsigned integers (2 or 4 bytes);
* ``part-N-T.off``  64-bit offsets of its documents within the part, and one more for the end;
* ``part-N-T.key``  for each document two 64-bit integers: 1 if its key is null, and the key;

and ``manifest.json``: the integer type, the parts, and each part's base, which is the number of ids in all
parts before it (prefix sums of the parts' counts). A document's place in the whole is base + offset.

T is a tag of the task attempt that wrote the files. The manifest names those of one attempt a part, so
nothing is moved or replaced; what a lost attempt has written is left unread.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import boxed, inside, scratch_dir
from .tokens import encoder, texts

ROWS = 1024  # of a batch that is read back


#: Hadoop's schemes by the names that these stores have here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}
#: What Hadoop's settings for S3 are called here.
S3_SETTINGS = {"access.key": "access_key", "secret.key": "secret_key", "session.token": "session_token", "endpoint": "endpoint_override", "endpoint.region": "region"}


def settings(spark: SparkSession, folder: str) -> dict[str, str]:
    """The session's Hadoop settings for the store of a folder, as ``_store`` takes them."""
    if not folder.startswith(("s3a:", "s3n:")):
        return {}
    conf = spark._jsc.hadoopConfiguration()
    bucket = folder.split("/")[2]
    found = {ours: conf.get(f"fs.s3a.bucket.{bucket}.{name}") or conf.get(f"fs.s3a.{name}") for name, ours in S3_SETTINGS.items()}
    return {k: v for k, v in found.items() if v}


def _store(folder: str, options: dict[str, str] | None = None):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.replace("file:", "file://", 1)
    scheme, mark, rest = folder.partition("://")
    scheme = SCHEMES.get(scheme, scheme)
    if scheme == "s3" and (options or folder.startswith(("s3a:", "s3n:"))):
        return fs.S3FileSystem(**(options or {})), rest.rstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}{mark}{rest}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", parts: int | None = None, by_word: bool = True) -> list[int]:
    """Write the ids of every whole text in ascending order of key; returns the parts' bases.

    Null texts count as empty: they hold the end id alone. Null keys come first; equal keys follow
    one another by the hash of their texts; an empty table gives empty parts; a caller's columns may
    have any name. Keys are integers, or cast to long; what can't be cast fails. The folder may be on any
    store that pyarrow reaches; ``s3a://`` takes the session's Hadoop settings for keys and endpoint.
    """
    spark = docs.sparkSession
    options = settings(spark, folder)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())  # more for a larger input

    def write_part(batches):
        import pyarrow as pa

        store, root = _store(folder, options)
        encode = encoder(tokenizer, by_word)
        end = np.array([end_id], encode.dtype).tobytes()
        part, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(root, recursive=True)
        name = lambda kind: f"{root}/{_file(part, tag)}.{kind}"
        lengths, keys = [np.zeros(1, "<i8")], []
        with store.open_output_stream(name("bin")) as out:
            for batch in batches:
                ids = [x + end for x in encode.many(texts(batch, "text"))]
                out.write(b"".join(ids))
                lengths.append(np.fromiter(map(len, ids), "<i8", len(ids)) // encode.dtype.itemsize)
                column = batch.column("key")
                keys.append(np.stack([np.asarray(column.is_null(), "<i8"), np.asarray(column.fill_null(0), "<i8")], 1))
        offsets = np.cumsum(np.concatenate(lengths), dtype="<i8")
        for kind, data in (("off", offsets), ("key", np.concatenate(keys) if keys else np.zeros((0, 2), "<i8"))):
            with store.open_output_stream(name(kind)) as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([int(offsets[-1])], pa.int64()), "tag": pa.array([tag])})

    rows = boxed(docs).select(inside(key).cast("long").alias("key"), inside(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    written = {r.part: r for r in ranged.mapInArrow(write_part, "part int, n long, tag string").collect()}  # a row a part
    n = max(written, default=-1) + 1
    bases = [0, *np.cumsum([written[p].n if p in written else 0 for p in range(n)]).tolist()][:n]
    store, root = _store(folder, options)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({"dtype": encoder(tokenizer, by_word).dtype.str, "end_id": end_id, "parts": {str(p): r.tag for p, r in sorted(written.items())}, "bases": bases}).encode())
    return bases


def _file(part: int, tag: str) -> str:
    return f"part-{part:06d}-{tag}"


def mapped(store, path: str, dtype: str) -> Callable[[int, int], np.ndarray]:
    """Gives the values from one place to another of a flat file: memory-mapped where the store is a mounted folder, else read by ranges."""
    from pyarrow import fs

    size = store.get_file_info(path).size // np.dtype(dtype).itemsize
    if isinstance(store, fs.LocalFileSystem):
        flat = np.memmap(path, dtype, "r") if size else np.zeros(0, dtype)
        return lambda a, b: flat[a:b]
    file, width = store.open_input_file(path), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(file.read_at((min(b, size) - a) * width, a * width), dtype)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of a folder: key, start (ids of all before it), n_tokens, ids_crc32 and,
    ``with_ids``, ids: array<int>. The checksum is of the ids as little-endian unsigned 32-bit integers.

    A null key comes back as null, documents of equal keys each come back, empty parts give no rows, and
    a document of a null or empty text has its end id alone.
    """
    options = settings(spark, folder)
    store, root = _store(folder, options)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())

    def read_parts(batches):
        import pyarrow as pa

        store, root = _store(folder, options)
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            if str(part) not in manifest["parts"]:
                continue
            name = f"{root}/{_file(part, manifest['parts'][str(part)])}"
            ids, offsets, keys = (mapped(store, f"{name}.{kind}", dtype) for kind, dtype in (("bin", manifest["dtype"]), ("off", "<i8"), ("key", "<i8")))
            n_docs = store.get_file_info(f"{name}.off").size // 8 - 1
            for a in range(0, n_docs, ROWS):
                at = offsets(a, min(a + ROWS, n_docs) + 1)
                some = ids(int(at[0]), int(at[-1]))
                own = [some[x:y] for x, y in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                k = keys(2 * a, 2 * (a + len(own))).reshape(-1, 2)
                out = {
                    "key": pa.array(k[:, 1], pa.int64(), mask=k[:, 0].astype(bool)), "start": pa.array(at[:-1] + manifest["bases"][part]), "n_tokens": pa.array(np.diff(at)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([x.astype("i4") for x in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    n = len(manifest["bases"])
    schema = "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read_parts, schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    import public_tokenizers

    folder = f"{scratch_dir(spark)}/tokens"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(spark, folder, with_ids=False).withColumnRenamed("key", "doc_id")
