"""Committed text export, the idempotent epoch log, counts as a side result."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import manifest as M
from tessera.sources import sinks
from tessera.sources.text_files import TextFilesSource, TextFilesWriter


def prompts(spark, n=200, parts=6):
    return spark.range(n).select(F.col("id").alias("index"), F.concat(F.lit("text é "), F.col("id")).alias("text")).repartition(parts)


def files(folder):
    return sorted(os.listdir(folder)) if os.path.exists(folder) else []


def test_every_question_one_file(spark, tmp_path):
    folder = str(tmp_path / "txt")
    sinks.export_text_files(prompts(spark), folder)
    assert files(folder) == sorted(f"{i}.txt" for i in range(200))
    assert open(f"{folder}/17.txt", encoding="utf-8").read() == "text é 17"
    sinks.export_text_files(prompts(spark, 3).withColumn("text", F.lit("new")), f"file://{folder}")  # replaces, leaves the rest
    assert len(files(folder)) == 200 and open(f"{folder}/2.txt").read() == "new" and open(f"{folder}/3.txt").read() == "text é 3"


def test_empty_and_null_texts_are_empty_files(spark, tmp_path):
    folder = str(tmp_path / "txt")
    sinks.export_text_files(spark.createDataFrame([(1, ""), (2, None)], "index long, text string"), folder)
    assert files(folder) == ["1.txt", "2.txt"] and os.path.getsize(f"{folder}/1.txt") == os.path.getsize(f"{folder}/2.txt") == 0
    sinks.export_text_files(spark.createDataFrame([], "index long, text string"), folder)
    assert files(folder) == ["1.txt", "2.txt"]


@pytest.mark.parametrize("bad", [(None, "x"), (5, "again")])
def test_nothing_appears_when_the_job_fails(spark, tmp_path, bad):
    """A NULL index, or one that occurs twice, also in different tasks: no file, no staging folder."""
    folder = str(tmp_path / "txt")
    rows = prompts(spark).unionByName(spark.createDataFrame([bad], "index long, text string"))
    with pytest.raises(Exception, match="index"):
        sinks.export_text_files(rows, folder)
    assert files(folder) == []


def test_a_task_tried_twice_leaves_one_whole_file_per_index(tmp_path):
    """An attempt that dies midway and one that is overtaken write beside the one that is committed."""
    folder = str(tmp_path / "txt")
    rows = [{"index": str(i), "text": f"t{i}"} for i in range(10)]
    writer = TextFilesWriter(folder, "_staging-x")

    def dying():
        yield rows[0]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    overtaken, done = writer.write(iter(rows)), writer.write(iter(rows))
    assert overtaken.folder != done.folder
    writer.commit([done, None])
    assert files(folder) == sorted(f"{i}.txt" for i in range(10))
    assert all(open(f"{folder}/{i}.txt").read() == f"t{i}" for i in range(10))


def test_aborting_leaves_what_was_there(tmp_path):
    folder = str(tmp_path / "txt")
    os.makedirs(folder)
    open(f"{folder}/0.txt", "w").write("old")
    writer = TextFilesWriter(folder, "_staging-x")
    writer.abort([writer.write(iter([{"index": "0", "text": "new"}])), None])
    assert files(folder) == ["0.txt"] and open(f"{folder}/0.txt").read() == "old"
    with pytest.raises(ValueError, match="index"):
        writer.write(iter([{"index": "a/b", "text": ""}]))
    lost = writer.write(iter([{"index": "1", "text": ""}]))
    os.remove(f"{lost.folder}/1.txt")
    with pytest.raises(RuntimeError, match="0 of 1 files"):
        writer.commit([lost])


def test_the_source_checks_its_columns(spark, tmp_path):
    spark.dataSource.register(TextFilesSource)
    with pytest.raises(Exception, match="index and text"):
        spark.range(3).write.format("text_files").mode("append").option("folder", str(tmp_path)).save()


EPOCHS = "run string, epoch int, train_loss double, val_loss double"


def log(spark, path):
    return sorted(tuple(r) for r in sinks.read_epoch_metrics(spark, path).collect())


def test_an_epoch_written_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.write_epoch_metrics(spark.createDataFrame([("7", 1, 0.5, 0.6), ("7", 2, 0.4, None), ("b", 1, 1.0, 1.0)], EPOCHS), path)
    sinks.write_epoch_metrics(spark.createDataFrame([("7", 2, 0.3, 0.35)], EPOCHS), path)
    want = [("7", 1, 0.5, 0.6), ("7", 2, 0.3, 0.35), ("b", 1, 1.0, 1.0)]
    assert log(spark, path) == want
    sinks.write_epoch_metrics(spark.createDataFrame([("7", 2, 0.3, 0.35)], EPOCHS), path)
    assert log(spark, path) == want
    with pytest.raises(ValueError, match="duplicate"):
        sinks.write_epoch_metrics(spark.createDataFrame([("c", 1, 0.3, 0.3), ("c", 1, 0.4, 0.4)], EPOCHS), path)


def test_a_repeated_batch_of_the_stream_changes_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("r", 1, 0.5, 0.6)], EPOCHS).write.parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(EPOCHS).parquet(source)
        sinks.stream_epoch_metrics(stream, path, str(tmp_path / checkpoint), available_now=True).awaitTermination(120)

    run("c1")
    run("c2")  # another checkpoint: the same rows come as a batch again
    assert log(spark, path) == [("r", 1, 0.5, 0.6)]
    spark.createDataFrame([("r", 2, 0.4, 0.5)], EPOCHS).write.mode("append").parquet(source)
    run("c1")
    assert log(spark, path) == [("r", 1, 0.5, 0.6), ("r", 2, 0.4, 0.5)]


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [(f"i{k}", "F", "val" if k % 5 == 0 else "train") for k in range(50)]
    manifest = spark.createDataFrame(rows, "img_name string, path_to_your_file string, split string").repartition(4)
    spark.sparkContext.setJobGroup("counted", "counted")
    got = sinks.write_counted(manifest, str(tmp_path / "m"), by="split", values=["train", "val"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    counts = {r["split"]: r["n"] for r in M.split_counts(manifest).collect()}
    assert got == {"n": 50, "n_train": counts["train"], "n_val": counts["val"]}
    assert len(jobs) == 2  # the shuffle of repartition and the write; none for the counts
    assert sinks.write_counted(prompts(spark, 30), str(tmp_path / "p")) == {"n": 30}
