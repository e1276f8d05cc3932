import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators.embedding import ContextLengthError, Patient, embed_in_ranges, read_ranges


def lengths(folder, called="lengths"):  # a class made here is sent to the workers with its code
    note = str(folder)

    class Lengths:
        """Embeds a text as its length, notes each call in a folder, and fails on one text while a file says so."""

        name, dim = called, 1

        def embed(self, texts):
            from pathlib import Path

            if "poison" in texts and Path(note, "fail").exists():
                raise RuntimeError("the model is gone")
            for t in texts:
                with open(f"{note}/calls", "a") as file:
                    file.write(t + "\n")
            return np.array([[float(len(t))] for t in texts])

    return Lengths()


def calls(folder):
    return (folder / "calls").read_text().split()


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    rows = [(i, "poison" if i == 40 else "x" * (i % 9 + 1) + str(i)) for i in range(80)]
    texts = spark.createDataFrame(rows, "id LONG, text STRING")
    (tmp_path / "fail").touch()
    with pytest.raises(Exception, match="the model is gone"):
        embed_in_ranges(texts, f"{tmp_path}/vectors", lengths(tmp_path), 8)
    kept = read_ranges(spark, f"{tmp_path}/vectors").count()
    share = texts.filter(F.pmod(F.xxhash64("id"), F.lit(8)) == F.pmod(F.xxhash64(F.lit(40).cast("long")), F.lit(8))).count()
    (tmp_path / "fail").unlink()
    before = len(calls(tmp_path))
    assert embed_in_ranges(texts, f"{tmp_path}/vectors", lengths(tmp_path), 8) == 80 - kept
    assert len(calls(tmp_path)) - before == 80 - kept and before <= kept + share
    found = {r["id"]: r["embedding"] for r in read_ranges(spark, f"{tmp_path}/vectors").collect()}
    assert found == {i: [float(len(t))] for i, t in rows}
    assert embed_in_ranges(texts, f"{tmp_path}/vectors", lengths(tmp_path), 8) == 0
    more = texts.union(spark.createDataFrame([(100, "new")], "id LONG, text STRING"))
    assert embed_in_ranges(more, f"{tmp_path}/vectors", lengths(tmp_path), 8) == 1


def test_vectors_of_another_model_are_refused(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a")], "id LONG, text STRING")
    embed_in_ranges(texts, f"{tmp_path}/vectors", lengths(tmp_path), 2)
    other = lengths(tmp_path, "other")
    with pytest.raises(ValueError, match="model mismatch"):
        embed_in_ranges(texts, f"{tmp_path}/vectors", other, 2)


class Moody:
    name, dim = "moody", 1

    def __init__(self, *moods):
        self.moods = list(moods)

    def embed(self, texts):
        mood = self.moods.pop(0)
        if isinstance(mood, Exception):
            raise mood
        time.sleep(mood)
        return np.zeros((len(texts), 1))


def test_calls_that_fail_or_hang_are_made_again():
    assert Patient(Moody(OSError("down"), 5, 0), timeout=0.2).embed(["a", "b"]).shape == (2, 1)
    with pytest.raises(TimeoutError):
        Patient(Moody(5, 5), timeout=0.1, retries=1).embed(["a"])
    with pytest.raises(OSError, match="down"):
        Patient(Moody(OSError("down")), retries=0).embed(["a"])
    once = Moody(ContextLengthError(), 0)
    with pytest.raises(ContextLengthError):
        Patient(once).embed(["a"])
    assert len(once.moods) == 1
