"""Shared plumbing of the training-data operators.

``materialize`` cuts lineage by writing a table into the cluster's shared
checkpoint folder.  ``ordered_positions`` numbers the rows of a global sort
without gathering a key in one task.  ``Sieve`` is a bitmap of fixed size that
separates rows which cannot match a key set from rows which may, so only the
latter have to be shuffled.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import pickle
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where a local session has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="terraledger-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def own(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact spelling even if others differ from them in case alone; ids as long integers."""
    places = [f"_c{i}" for i in range(len(df.columns))]
    cols = [F.col(places[df.columns.index(n)]) for n in names]
    return df.toDF(*places).select(*[(c.cast("long") if n in ("doc_id", "vec_id") else c).alias(n) for c, n in zip(cols, names, strict=True)])


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            discard(spark, path)
    except Exception:  # the JVM may be gone by now; the folder is scratch
        return


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; return it read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terraledger-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_at_exit, spark, path)
    return spark.read.schema(schema).parquet(path), path


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of a few rows made on the driver alone; from a plain list Spark would start Python workers for it."""
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema))


def _give_back(whole: bool) -> None:
    """Let a Python worker return freed memory: large blocks when they are freed, or (``whole``) all it can now."""
    try:
        libc = ctypes.CDLL(None)
        if whole:
            libc.malloc_trim(0)
        else:
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: a fixed one, as otherwise it rises with every large block freed
            libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # not glibc
        return


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with record batches bounded by bytes, in workers that return what they freed when a task ends."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) != str(SLICE_BYTES):
        conf.set(key, str(SLICE_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back(False)
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        _give_back(True)

    return df.mapInArrow(tidy, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each carries about ``most`` bytes of one column."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Record batches put together until they have about ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


_HELD: dict = {}


def held(key: str, make):
    """A worker process's store for one operator; asking for another's frees the one before."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _give_back(True)
        _HELD[key] = make()
    return _HELD[key]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


# ---------------------------------------------------------------- global order

_EDGE = T.StructType([
    T.StructField("_pid", T.IntegerType()), T.StructField("_row", T.LongType()),
    T.StructField("_run", T.LongType()), T.StructField("_cum", T.LongType()),
    T.StructField("_rs_row", T.LongType()), T.StructField("_rs_cum", T.LongType()),
    T.StructField("_edge", T.BinaryType()),
])


def _edge_key(b: pa.RecordBatch, run: Sequence[str], row: int) -> bytes:
    """A row's run values, as their SHA-256 digest where they are long: it goes to the driver."""
    key = pickle.dumps([b.column(c)[row].as_py() for c in run])
    return key if len(key) <= 64 else hashlib.sha256(key).digest()


def ordered_positions(df: DataFrame, run: Sequence[str], tie: Sequence[str], carry: Sequence[str], weight: str | None = None, lead: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Number the rows of ``df`` in the order of ``run + tie``.

    ``lead`` are functions of the ``run`` values that sort before them: short
    keys, so that neither the sampled range bounds nor the comparisons carry
    long values.  Returns (frame, path of its table).  The frame has ``carry`` and
    ``pos`` (0-based global row number), ``run_id`` (dense number of the
    distinct ``run`` values), ``cum`` (sum of ``weight`` over earlier rows),
    ``run_pos`` and ``run_cum`` (``pos`` and ``cum`` of the run's first row).

    The rows are range-partitioned on ``lead`` (or ``run``) and ``tie``, so a value that a
    third of the rows hold still spreads over many tasks.  Each task numbers
    its own rows and adds one edge row; the driver sees only the edge rows,
    one a partition, and turns them into offsets.
    """
    spark, keys, ranges = df.sparkSession, [*lead, *run, *tie], [*(lead or run), *tie]
    cols = list(dict.fromkeys([*keys, *carry, *([weight] if weight else [])]))
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in carry] + _EDGE.fields)
    out_schema, n_carry = arrow_schema(schema), len(carry)
    run, carry = list(run), list(carry)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rows = runs = cum = 0
        first = last = None
        rs = (0, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for c in run:
                x = b.column(c)
                if n > 1:
                    a, z = x.slice(0, n - 1), x.slice(1)
                    same = pc.or_kleene(pc.equal(a, z), pc.and_(pc.is_null(a), pc.is_null(z)))
                    change[1:] |= ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
            head = _edge_key(b, run, 0)
            if last is None:
                first, runs = head, -1
            change[0] = head != last
            last = _edge_key(b, run, n - 1)
            w = np.zeros(n, dtype=np.int64) if weight is None else b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.arange(rows, rows + n)
            before = cum + np.cumsum(w) - w
            run_no = runs + np.cumsum(change)
            at = np.where(change, np.arange(n), -1)
            at = np.maximum.accumulate(at)
            rs_row, rs_cum = np.where(at < 0, rs[0], row[at]), np.where(at < 0, rs[1], before[at])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in carry] + [pa.array(np.full(n, pid, dtype=np.int32)), pa.array(row), pa.array(run_no), pa.array(before), pa.array(rs_row), pa.array(rs_cum), pa.nulls(n, pa.binary())], schema=out_schema)
            rows, runs, cum, rs = rows + n, int(run_no[-1]), int(cum + w.sum()), (int(rs_row[-1]), int(rs_cum[-1]))
        if rows:
            edge = pickle.dumps((rows, runs + 1, cum, first, last, rs))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, out_schema.field(i).type) for i in range(n_carry)] + [pa.array([pid], pa.int32())] + [pa.nulls(1, pa.int64())] * 5 + [pa.array([edge], pa.binary())], schema=out_schema)

    ranged = df.select(*cols).repartitionByRange(*[F.col(c) for c in ranges]).sortWithinPartitions(*keys)
    table, path = materialize(mapped(ranged, number, schema))
    edges = sorted((r[0], pickle.loads(r[1])) for r in table.where("_edge is not null").select("_pid", "_edge").collect())
    offsets, row_off, run_off, cum_off, before, start = [], 0, 0, 0, None, (0, 0)
    for pid, (rows, runs, cum, first, last, rs) in edges:
        joined = first == before
        head = start if joined else (row_off, cum_off)
        run_off -= joined
        offsets.append((pid, row_off, run_off, cum_off, head[0], head[1]))
        start = head if runs == 1 else (row_off + rs[0], cum_off + rs[1])
        row_off, run_off, cum_off, before = row_off + rows, run_off + runs, cum_off + cum, last
    off = small_table(spark, offsets, "_pid int, _ro long, _no long, _co long, _hr long, _hc long")
    out = table.where("_edge is null").join(F.broadcast(off), "_pid").select(
        *carry, (F.col("_row") + F.col("_ro")).alias("pos"), (F.col("_run") + F.col("_no")).alias("run_id"), (F.col("_cum") + F.col("_co")).alias("cum"),
        F.when(F.col("_run") == 0, F.col("_hr")).otherwise(F.col("_rs_row") + F.col("_ro")).alias("run_pos"),
        F.when(F.col("_run") == 0, F.col("_hc")).otherwise(F.col("_rs_cum") + F.col("_co")).alias("run_cum"))
    return out, path


# ---------------------------------------------------------------- bitmap sieve

#: Bits of a sieve: 2^25 bits are 1024 rows of 4 KB, whatever the input.
SIEVE_BITS = 25


class Sieve:
    """A bitmap of 2**bits positions over hashed keys, as a frame of at most 2**(bits-15) rows.

    ``split`` gives (rows whose key is surely absent, rows whose key may be
    present).  Its size does not depend on the data; when the keys outgrow it,
    it lets more rows through and the result stays the same.
    """

    def __init__(self, keys: DataFrame, columns: Sequence[str], bits: int = SIEVE_BITS):
        self.bits, self.columns = bits, list(columns)
        at = keys.select(self._slot([F.col(c) for c in columns]).alias("p"))
        marked = at.groupBy(F.expr("bitmap_bucket_number(p)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("_bits"))
        four = lambda i: F.conv(F.hex(F.substring("_bits", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
        signed = lambda x: ((x + F.lit(1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")
        ints = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: signed(four(i)))
        self.table, self.path = materialize(marked.select("_bucket", ints.alias("_bits")))

    def _slot(self, cols: Sequence[Column]) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(1 << self.bits)).cast("long") + F.lit(1).cast("long")

    def mark(self, df: DataFrame, cols: Sequence[Column], name: str = "_maybe") -> DataFrame:
        """``df`` with a boolean: false where the key is surely absent."""
        hit = df.withColumn("_slot", self._slot(cols)).withColumn("_bucket", F.expr("bitmap_bucket_number(_slot)")).join(F.broadcast(self.table), "_bucket", "left")
        # a bucket is 1024 numbers of four bytes, the first byte highest
        bit = F.expr("shiftright(_bits[cast(bitmap_bit_position(_slot) div 32 as int)], cast((3 - bitmap_bit_position(_slot) div 8 % 4) * 8 + bitmap_bit_position(_slot) % 8 as int)) & 1")
        return hit.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("_slot", "_bucket", "_bits")


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str, parts: int = 1024) -> DataFrame:
    """Inner join of ``rows`` with the one row that ``facts`` has for a key; both are read twice, so they should be tables.

    ``count`` says how many rows a key has.  Keys with over 1/parts of all rows,
    fewer than ``parts`` in number, are joined by broadcast where the rows are; the
    others are shuffled.  So no task gets many times its share.
    """
    keys = list(keys)
    bound = facts.agg((F.sum(count) / parts).alias("_bound"))
    split = facts.crossJoin(F.broadcast(bound))  # one row
    heavy = split.where(F.col(count) > F.col("_bound")).drop("_bound")
    light = split.where(F.col(count) <= F.col("_bound")).drop("_bound")
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
