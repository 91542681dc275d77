"""Runs that go on where they stopped, rows set aside instead of lost, archives of arrays, and reports as files."""

from __future__ import annotations

import io
import math
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackloom.operators.batches import starts
from trackloom.operators.quantiles import with_quantiles
from trackloom.operators.summaries import calibrated
from trackloom.plans.storage import shared_folder, written
from trackloom.sources.reports import RUN_SUMMARY, pending
from trackloom.sources.splits import FileSink, file_system

#: Lines of a file of a sequence, about.
LINES = 2_000_000
MEMBERS = ("cx", "cy", "cz", "l", "w", "h", "rot_z")


# ------------------------------------------------------------------ incremental output


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, run): sequences whose output under path is whole, and the run that wrote it."""
    schema = "seq_name string, run string"
    return spark.read.schema(schema).parquet(f"{path}/finished") if exists(spark, f"{path}/finished") else spark.createDataFrame([], schema)


def write_pending(rows: DataFrame, path: str, run: str | None = None) -> DataFrame:
    """Write rows(seq_name, value) of the sequences that are not finished as lines of text, one folder each under path/data; returns the names written.

    Only folders of these sequences are replaced. Names go to the list of finished ones after their data, in one commit; a run that dies before that
    leaves what the next run replaces. Rows are not computed for sequences that are finished.
    """
    spark = rows.sparkSession
    run = run or uuid.uuid4().hex
    sizes = rows.groupBy("seq_name").agg(F.ceil(F.count(F.lit(1)) / LINES).cast("int").alias("files"))
    todo = written(pending(sizes, finished(spark, path)))
    # a sequence is one task's, so that there are as many files as sequences, not as sequences times tasks; a large one is several files
    out = rows.join(todo, "seq_name").select("seq_name", "value", F.pmod(F.xxhash64("value"), "files").alias("_file"))
    out = out.repartition("seq_name", "_file").select("seq_name", "value")
    out.write.partitionBy("seq_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(f"{path}/data")
    todo = todo.select("seq_name")
    todo.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return todo


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq_name, value, run) of finished sequences."""
    lines = spark.read.schema("value string, seq_name string").text(f"{path}/data")
    return lines.join(finished(spark, path), "seq_name")


# ------------------------------------------------------------------ rows set aside


def wrong_with(rows: DataFrame, key: Sequence[str]) -> Column:
    """What is wrong with a box, null if nothing: members that are missing, by name, such as are no numbers, sizes below zero, or an id that its frame has twice."""
    members = [F.col(m).cast("double") for m in MEMBERS]
    missing = F.array_join(F.filter(F.array(*(F.when(c.isNull(), F.lit(m)) for c, m in zip(members, MEMBERS))), lambda m: m.isNotNull()), ",")
    finite = F.lit(True)
    for c in members:
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    twice = F.count(F.lit(1)).over(W.partitionBy(*key)) > 1
    sizes = (F.col("l") < 0) | (F.col("w") < 0) | (F.col("h") < 0)
    return F.when(missing != "", F.concat(F.lit("missing "), missing)).when(~finite, "not finite").when(sizes, "negative size").when(twice, "id given twice")


def quarantined(rows: DataFrame, key: Sequence[str] = ("seq_name", "frame_idx", "track_id"), folder: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """rows whose box and id are right, the others with `wrong`, and counts of both, from one pass over rows.

    The pass writes both as parts of one table in the shared folder (or in folder), which later reads take one part of; counts are observed on the way. All rows that share
    an id in a frame are set aside. A column named wrong is replaced.
    """
    spark = rows.sparkSession
    seen = Observation()
    marked = rows.withColumn("wrong", wrong_with(rows, key))
    marked = marked.observe(seen, F.count(F.lit(1)).alias("all"), F.count("wrong").alias("rejected")).withColumn("_ok", F.col("wrong").isNull())
    path = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    marked.write.partitionBy("_ok").mode("overwrite").parquet(path)
    counts = {"all": int(seen.get["all"]), "rejected": int(seen.get["rejected"])}
    both = spark.read.schema(marked.schema).parquet(path)
    return both.filter("_ok").drop("_ok", "wrong"), both.filter("NOT _ok").drop("_ok"), counts


# ------------------------------------------------------------------ archives of arrays

#: The arrays of an archive that hold scores of true and false detections.
ARRAYS = {"tp_scores": "tp", "fp_scores": "fp"}


def archive_bytes(arrays: Mapping[str, object]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


#: Scores that are held at once when an archive is written, and bytes of it that go to its file at once.
_HELD, _PART = 1 << 20, 1 << 22


class _Sent(io.RawIOBase):
    """What a zip file is written to: its bytes wait until they are taken."""

    def __init__(self):
        self.waiting = bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.waiting += data
        return len(data)

    def taken(self) -> bytes:
        out, self.waiting = bytes(self.waiting), bytearray()
        return out


def spread(values: np.ndarray, counts: np.ndarray, most: int = _HELD) -> Iterator[np.ndarray]:
    """Each value as often as its count says, in pieces of less than twice `most`."""
    k = -(-counts // most)
    values, n = np.repeat(values, k), np.full(int(k.sum()), most)
    n[np.cumsum(k) - 1] = counts - (k - 1) * most
    piece = np.cumsum(n) // most
    for i in np.unique(piece):
        yield np.repeat(values[piece == i], n[piece == i])


def write_archives(scores: DataFrame, path: str, by: str) -> None:
    """scores(by, kind, score) as one archive of arrays for each value of `by`, named by it. Scores are counted by value first; the task that writes an archive goes
    through its values in order and sends the file on in parts, so neither the rows nor the arrays are held."""
    value = F.coalesce(F.col("score").cast("float"), F.lit(float("nan")).cast("float"))
    counts = written(scores.groupBy(F.col(by).cast("string").alias("by"), "kind", value.alias("score")).agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("by", "kind").agg(F.sum("n").alias("total")).select(F.col("by").alias("_by"), F.col("kind").alias("_kind"), "total")
    rows = counts.join(totals, F.col("by").eqNullSafe(F.col("_by")) & F.col("kind").eqNullSafe(F.col("_kind"))).select("by", "kind", "score", "n", "total")
    array_of = {kind: name for name, kind in ARRAYS.items()}

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent, archive, member, begun, last = _Sent(), None, None, set(), None

        def begin(kind: str, n: int):
            begun.add(kind)
            out = archive.open(f"{array_of[kind]}.npy", "w", force_zip64=True)
            np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (n,)})
            return out

        def part() -> pd.DataFrame:
            return pd.DataFrame({"name": [f"{last}.npz"], "body": [sent.taken()]})

        def finish() -> pd.DataFrame:
            if member is not None:
                member.close()
            for kind in array_of:
                if kind not in begun:
                    begin(kind, 0).close()
            archive.close()
            return part()

        for pdf in batches:
            at = starts(pdf, ["by", "kind"])
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(pdf)]):
                name, kind = pdf["by"].iloc[a], pdf["kind"].iloc[a]
                if archive is None or name != last:
                    if archive is not None:
                        yield finish()
                    archive, member, last = zipfile.ZipFile(sent, "w", zipfile.ZIP_DEFLATED), None, name
                    begun.clear()
                if kind not in array_of:
                    continue
                if kind not in begun:
                    if member is not None:
                        member.close()
                    member = begin(kind, int(pdf["total"].iloc[a]))
                for values in spread(pdf["score"].to_numpy(np.float32)[a:b], pdf["n"].to_numpy()[a:b]):
                    member.write(values.astype("<f4").tobytes())
                    if len(sent.waiting) > _PART:
                        yield part()
        if archive is not None:
            yield finish()

    scores.sparkSession.dataSource.register(FileSink)
    files = rows.repartition("by").sortWithinPartitions("by", "kind", "score").mapInPandas(archives, "name string, body binary")
    files.write.format("whole_files").mode("append").save(path)


def stored_array(archive: zipfile.ZipFile, name: str, most: int) -> Iterator[np.ndarray]:
    """An array of an archive, flat, in pieces of at most `most` values. One in Fortran's order is held whole, as it has to be turned."""
    with archive.open(f"{name}.npy") as f:
        version = np.lib.format.read_magic(f)
        shape, turned, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if not turned and not kind.hasobject:
            left = math.prod(shape)
            while left:
                n = min(left, most)
                yield np.frombuffer(f.read(n * kind.itemsize), kind)
                left -= n
            return
    with archive.open(f"{name}.npy") as f:
        x = np.lib.format.read_array(f, allow_pickle=False).reshape(-1)
    yield from (x[at : at + most] for at in range(0, len(x), most))


def read_archives(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """(name, kind, score) of all archives under path: finite scores, clipped to [0, 1], as float32 has them; name is the file's without its ending. Each array is a task's, which
    decodes it in Arrow batches of at most `most` rows and holds no more. Other arrays of an archive are ignored; one without both arrays of scores is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, array in zip(*(batch.column(c).to_pylist() for c in ("name", "path", "array"))):
                store, place = file_system(re.sub(r"^file:/+", "/", file))
                with store.open_input_file(place) as f, zipfile.ZipFile(f) as archive:
                    held = [n.removesuffix(".npy") for n in archive.namelist()]
                    if not set(ARRAYS) <= set(held):
                        raise ValueError(f"{name} has no {' and '.join(ARRAYS)} but {held}")
                    for x in stored_array(archive, array, most):
                        x = x.astype(np.float32)
                        x = np.clip(x[np.isfinite(x)], 0, 1).astype(float)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array([ARRAYS[array]] * len(x), pa.string()), pa.array(x)], names=["name", "kind", "score"])

    arrays = files.select(F.regexp_extract("path", r"([^/]*)\.npz$", 1).alias("name"), "path", F.explode(F.lit(list(ARRAYS))).alias("array"))
    return arrays.repartition(spark.sparkContext.defaultParallelism, "path", "array").mapInArrow(decode, "name string, kind string, score double")


# ------------------------------------------------------------------ reports as files


def score_cube(scores: DataFrame, bins: int) -> DataFrame:
    """scores(split, kind, score) counted and summed by split, kind and bin, by each of the coarser groupings that reports need, in one pass. `level` says which:
    0 split, kind, bin; 2 kind and bin; 1 split and kind; 3 kind alone (bits of what is summed up: bin 1, split 2)."""
    at = F.least(F.floor(F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    rows = scores.filter(F.col("score").isNotNull()).select("split", "kind", "score", at.alias("bin"))
    sets = [["split", "kind", "bin"], ["kind", "bin"], ["split", "kind"], ["kind"]]
    cube = rows.groupingSets([[F.col(c) for c in s] for s in sets], "split", "kind", "bin").agg(
        F.grouping("bin").cast("int").alias("_bin"), F.grouping("split").cast("int").alias("_split"), F.count(F.lit(1)).alias("n"), F.min("score").alias("min"), F.max("score").alias("max"), F.sum("score").alias("sum")
    )
    return cube.withColumn("level", F.col("_bin") + 2 * F.col("_split")).drop("_bin", "_split")


def write_score_report(scores: DataFrame, path: str, bins: int = 20, laplace: float = 1.0) -> None:
    """scores(split, kind, score) as a distribution (JSON, a folder for each split), a calibrator (CSV) and a summary (JSON) under path. Scores are
    read once for all counts; quantiles of the summary are found from counts by value."""
    cube = written(score_cube(scores, bins))
    cube.filter("level = 0").select("split", "kind", "bin", "n", "min", "max").repartition("split").sortWithinPartitions("kind", "bin").write.partitionBy("split").mode("overwrite").json(f"{path}/distribution")
    counts = cube.filter("level = 2").groupBy("bin").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("tp", "fp")))
    calibrated(counts, bins, laplace).coalesce(1).sortWithinPartitions("bin").write.mode("overwrite").option("header", True).csv(f"{path}/calibrator")
    whole = cube.filter("level = 3").select("kind", "n", "min", "max", (F.col("sum") / F.col("n")).alias("mean"))
    whole = with_quantiles(whole, scores, "score", ["kind"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    per_split = cube.filter("level = 1").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("split", "n"))).alias("per_split"))  # a few splits
    whole.join(per_split, "kind").coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def read_score_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distribution, calibrator and summary as write_score_report() wrote them."""
    distribution = spark.read.schema("kind string, bin int, n long, min double, max double, split string").json(f"{path}/distribution")
    calibrator = spark.read.schema("bin int, tp long, fp long, precision double").csv(f"{path}/calibrator", header=True)
    summary = spark.read.schema("kind string, n long, min double, max double, mean double, p05 double, p50 double, p95 double, per_split array<struct<split: string, n: long>>").json(f"{path}/summary")
    return distribution, calibrator, summary


_SUMMARY = dict(zip(RUN_SUMMARY, ("string", "string", "long", "double", "double", "double", "double", "double"))) | {"error": "string"}


def write_run_summary(runs: DataFrame, status: DataFrame, path: str, *by: str) -> None:
    """runs(by..., seq_name, statistics) and status(by..., seq_name, status, error) of a run as files under path: a row for each sequence as CSV, a folder for each value of
    `by`, and totals as JSON. Sequences that failed or were skipped have zeros, and failed ones their error."""
    rows = status.join(runs, [*by, "seq_name"], "left")
    numbers = {c: F.coalesce(F.when(F.col("status") == "ok", F.col(c)), F.lit(0)).cast(_SUMMARY[c]).alias(c) for c in RUN_SUMMARY[2:]}
    rows = written(rows.select(*by, "seq_name", "status", *numbers.values(), "error"))
    rows.repartition(*by).sortWithinPartitions("seq_name").write.partitionBy(*by).mode("overwrite").option("header", True).csv(f"{path}/sequences")
    ok = F.col("status") == "ok"
    of = lambda f, c: F.coalesce(f(F.when(ok, F.col(c))), F.lit(0.0))
    seconds = F.sum(F.when(ok, F.col("num_frames") * F.col("mean_step_ms"))) / 1000
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_sequences"), F.count_if(ok).alias("num_ok"), F.count_if(F.col("status") == "error").alias("num_error"), F.sum("num_frames").alias("num_frames"),
        of(F.avg, "fps").alias("fps_mean"), of(F.min, "fps").alias("fps_min"), of(F.max, "fps").alias("fps_max"), F.coalesce(F.sum("num_frames") / seconds, F.lit(0.0)).alias("fps_weighted"), of(F.avg, "mean_step_ms").alias("step_mean"),
    )
    totals.repartition(*by).write.partitionBy(*by).mode("overwrite").json(f"{path}/totals")


def read_run_summary(spark: SparkSession, path: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """The rows of sequences and the totals that write_run_summary() wrote; columns of `by` are texts."""
    keys = "".join(f", {c} string" for c in by)
    sequences = spark.read.schema(", ".join(f"{c} {k}" for c, k in _SUMMARY.items()) + keys).csv(f"{path}/sequences", header=True)
    totals = spark.read.schema(f"num_sequences long, num_ok long, num_error long, num_frames long, fps_mean double, fps_min double, fps_max double, fps_weighted double, step_mean double{keys}").json(f"{path}/totals")
    return sequences, totals
