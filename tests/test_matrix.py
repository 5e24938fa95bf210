"""The fusion matrix against every cell's readings judged by themselves."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import plates
from lanewise.operators import fusion, grid, voting


def plainly(reads, truth, key, order):
    """All readings of each cell, beside each other, given to the two fusions."""
    place = F.row_number().over(Window.partitionBy("model", key).orderBy(order, "text", "ocr_conf", "plate_score"))
    ranked = reads.where(plates.clean(F.col("text")).isNotNull()).withColumn("_n", place)
    cells = ranked.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in fusion.TOP_K]))).where("_n <= top_k")
    cells = cells.withColumn("beta_p", F.explode(F.array(*[F.lit(b) for b in fusion.BETAS])))
    by = ["model", "top_k", "beta_p", key]
    voted = voting.consensus(cells, by, order, beta=F.col("beta_p")).select(*by, F.col("text").alias("char_voting"))
    summed = voting.log_odds(cells, by, order, F.col("beta_p")).select(*by, F.col("text").alias("logprob_sum"))
    read = voted.join(summed, by, "left").select(*by, F.inline(F.array(*[F.struct(F.lit(f).alias("fusion"), F.col(f).alias("text")) for f in fusion.FUSIONS])))
    known = truth.where("coalesce(legible, true) and replace(plate, '-', '') != ''").select(key, F.upper(F.replace("plate", F.lit("-"), F.lit(""))).alias("gt"))
    return sorted(read.join(known, key).select("model", "top_k", "fusion", "beta_p", key, "gt", F.coalesce("text", F.lit("")).alias("text")).collect())


def scored(rows):
    """The matrix of the rows of plainly()."""
    cells = {}
    for model, k, f, beta, _, gt, text in rows:
        cells.setdefault((model, k, f, beta), []).append((gt, text))
    out = {}
    for cell, pairs in cells.items():
        edits = [distance(a, b) for a, b in pairs]
        tenths = lambda a, b: (a * 2000 + b) // (b * 2) / 10
        out[cell] = (
            tenths(edits.count(0), len(pairs)), tenths(sum(max(0, len(a) - d) for (a, _), d in zip(pairs, edits, strict=True)), sum(len(a) for a, _ in pairs)),
            tenths(sum(b[:1] == a[:1] for a, b in pairs), len(pairs)), sum(b[:1] == "P" != a[:1] for a, b in pairs), len(pairs),
        )
    return out


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def scene(seed, events=150):
    rng, reads, truth = random.Random(seed), [], []
    for e in range(events):
        plate = "".join(rng.choices("PPGÑA", k=3)) + "".join(rng.choices("0123456789", k=4))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            truth.append((e, rng.choice([plate, plate[:3] + "-" + plate[3:], plate.lower(), "", None]), rng.choice([True, True, None, False])))
        for m in "xyz":
            for _ in range(rng.randint(0, 12)):
                text = list(plate)
                for _ in range(rng.choice([0, 0, 1, 2, 3])):
                    text[rng.randrange(len(text))] = rng.choice("PGA170Ñ-b ")
                text = rng.choice(["".join(text)] * 8 + ["CHEVROLET", "AB", "--", None, plate + plate + plate[:5], plate + plate + plate[:4], plate[:5]])
                reads.append((m, e, rng.choice([1, 1, 2, 3, None]), text, rng.choice([0.5, 0.7, 0.9, 0.95, None]), rng.choice([0.0, 0.5, 1.0, None])))
    rng.shuffle(reads)
    rng.shuffle(truth)
    return reads, truth


@pytest.mark.parametrize("rows", [grid.ROWS, 40])
def test_matrix_equals_each_cell_by_itself(spark, monkeypatch, rows):
    monkeypatch.setattr(grid, "ROWS", rows)
    reads, truth = scene(rows)
    reads = spark.createDataFrame(reads, "model string, event_id bigint, ord int, text string, ocr_conf double, plate_score double")
    truth = spark.createDataFrame(truth, "event_id bigint, plate string, legible boolean")
    found = {tuple(r)[:2] + (r.fusion, r.beta_p): tuple(r)[4:] for r in fusion.matrix(reads, truth, "event_id", "ord").collect()}
    assert len(found) == 3 * 24
    assert found == scored(plainly(reads, truth, "event_id", "ord"))


def test_matrix_moves_readings_once(spark):
    """Not twelve times, for every cell: only the readings and plates, the counts of each set of cells, and the cells."""
    reads = spark.createDataFrame([("x", 1, 1, "PAA1234", 0.9, 1.0)], "model string, event_id int, ord int, text string, ocr_conf double, plate_score double")
    truth = spark.createDataFrame([(1, "PAA1234", True)], "event_id int, plate string, legible boolean")
    assert fusion.matrix(reads, truth, "event_id", "ord")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 3


def test_edits_up_to_two():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ABÑ1", k=rng.randint(1, 19))) for _ in range(150)} | {"ABCDEFGHIJKLMNOPQ", "ABCDEFGHIJKLMNOPR", "ABCDEFGHIJKLMNOP"}, key=str.encode)
    a, b = np.divmod(np.arange(len(words) ** 2), len(words))
    found = grid.Texts(pa.array(words)).edits(a, b)
    assert found.tolist() == [min(3, distance(words[i], words[j])) for i, j in zip(a, b, strict=True)]
    assert [grid.near(words[i], words[j]) for i, j in zip(a, b, strict=True)] == found.tolist()
