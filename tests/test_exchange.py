"""The keyed exchange of positions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewatt.operators.exchange import partner, partner_sql, rectangle, with_partner
from tidewatt.operators.positions import number_rows
from tidewatt.plans import models as md
from tidewatt.settings import Boosting, Forest, Search


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 101, 1009, 4099])
def test_every_position_is_given_once_and_sql_agrees(spark, n):
    got = spark.range(n).select("id", partner(F.col("id"), n, 7).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    want = duckdb.sql(f"WITH RECURSIVE t AS (SELECT range AS pos FROM range({n})), {partner_sql('t', '7')} SELECT pos, partner FROM exchanged").fetchall()
    assert {(r.id, r.p) for r in got} == set(want)


def test_positions_are_mixed(spark):
    n = 4000
    p = {k: [r.p for r in spark.range(n).select(partner(F.col("id"), n, k).alias("p")).collect()] for k in (1, 2)}
    assert sum(a == b for a, b in zip(p[1], p[2])) < 20
    assert sum(i == v for i, v in enumerate(p[1])) < 20
    # Neighbours part: a rotation would keep their distance.
    assert len({(b - a) % n for a, b in zip(p[1], p[1][1:])}) > n // 3
    middle = (n - 1) / 2
    assert abs(sum((i - middle) * (v - middle) for i, v in enumerate(p[1]))) < 0.1 * n**3 / 12


def test_rectangle_is_tight_at_any_size():
    for n in (1, 7, 10**6 + 3, 10**12 + 39):
        a, b = rectangle(n)
        assert 0 <= a * b - n < max(2, n**0.5 / 20 + 10)


def test_importance_of_rows_that_share_a_key_and_of_no_rows(spark):
    rows = [(k % 3, float(k), float(-k % 7), 2.0 * k) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    model = md.fit(df, ["a", "b"], "y", "linear")
    got = {r.feature: r.importance for r in md.permutation_importance(model, df, ["a", "b"], "y", ["id"]).collect()}
    assert got["a"] > 10 and abs(got["b"]) < 1e-6
    assert md.permutation_importance(model, df.filter("id > 9"), ["a", "b"], "y", ["id"]).count() == 0


@pytest.mark.parametrize("n", [1, 5, 101, 4099])
def test_partner_by_steps_is_the_same_exchange(spark, n):
    rows = with_partner(spark.range(n), "id", n, 7, "p")
    assert rows.filter(F.col("p") != partner(F.col("id"), n, 7)).count() == 0
    assert not rows.schema["p"].nullable  # a nullable one would be worked out again for a filter


def test_importance_of_a_linear_model_is_that_of_scored_variants(spark):
    df = spark.range(300).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    df = df.withColumn("y", 3 * F.col("a") - F.col("b") + F.sin(F.col("id") * 7))
    model = md.fit(df, ["a", "b"], "y", "linear")
    rows = number_rows(df, [], ["id"], "at")
    rows = rows.join(with_partner(rows, "at", 300, 42, "p").select("id", "p"), "id")
    pairs = rows.join(rows.select(F.col("at").alias("p"), F.col("a").alias("a2"), F.col("b").alias("b2")), "p")
    rmse = lambda of: md.compare({"m": model}, of, "y").first()["rmse"]
    want = {f: rmse(pairs.withColumn(f, F.col(f"{f}2"))) - rmse(df) for f in ("a", "b")}
    got = {r.feature: r.importance for r in md.permutation_importance(model, df, ["a", "b"], "y", ["id"], repeats=1).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    # Rows packed in one vector column give the same model and the same importances.
    packed = md.feature_rows(df, ["a", "b"], "y").select("id", "y", "features")
    again = md.fit(packed, ["a", "b"], "y", "linear")
    assert list(again.stages[-1].coefficients) == pytest.approx(list(model.stages[-1].coefficients))
    same = md.permutation_importance(again, packed, ["a", "b"], "y", ["id"], repeats=1).collect()
    assert {r.feature: r.importance for r in same} == pytest.approx(want, abs=1e-9)


def test_search_over_packed_rows_is_that_over_wide_ones(spark):
    df = spark.range(240).select(F.col("id").alias("t"), F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b")).coalesce(1)
    df = df.withColumn("y", 3 * F.col("a") - F.col("b"))
    search = Search(draws=2, splits=2, grid={"maxIter": [1, 2], "maxDepth": [2]})
    packed = md.feature_rows(df, ["a", "b"], "y").select("t", "y", "features")
    (one, wide), (other, narrow) = (md.random_search(of, ["a", "b"], "y", "t", search) for of in (df, packed))
    assert one == other
    assert [r.rmse for r in narrow.collect()] == pytest.approx([r.rmse for r in wide.collect()])


def test_fits_run_side_by_side_only_while_their_rows_fit_in_memory(spark, monkeypatch):
    df = spark.range(60).selectExpr("cast(id AS double) AS a", "cast(id % 7 AS double) AS b", "cast(id % 5 AS double) AS y")
    kinds = {
        "line": ("linear", None),
        "trees": ("forest", Forest(trees=2, depth=2)),
        "steps": ("boosting", Boosting(rounds=2, depth=1)),
        "more": ("boosting", Boosting(rounds=2, depth=1)),
    }
    side_by_side, used = md.side_by_side, []

    def counted(session, tasks, parallel):
        used.append(parallel)
        return side_by_side(session, tasks, parallel)

    monkeypatch.setattr(md, "side_by_side", counted)
    assert md.storage_bytes(spark) > 1 << 20
    tables = []
    # A row of the forest is 216 bytes, of either booster 212.
    for memory in (60 * 640, 60 * 430, 60 * 427):
        monkeypatch.setattr(md, "storage_bytes", lambda _, memory=memory: memory)
        _, table = md.benchmark(df, df, ["a", "b"], "y", kinds)
        tables.append({r.model: round(r.rmse, 9) for r in table.collect()})
    assert used == [3, 2, 1]
    assert tables[0] == tables[1] == tables[2]


def test_a_search_fits_fewer_draws_at_a_time_when_their_rows_exceed_the_memory(spark, monkeypatch):
    df = spark.range(60).selectExpr("id AS t", "cast(id % 7 AS double) AS a", "cast(id % 5 AS double) AS y")
    search = Search(draws=2, splits=2, parallel=2, grid={"maxIter": [1, 2], "maxDepth": [1]})
    side_by_side, used = md.side_by_side, []

    def counted(session, tasks, parallel):
        used.append(parallel)
        return side_by_side(session, tasks, parallel)

    monkeypatch.setattr(md, "side_by_side", counted)
    plenty, _ = md.random_search(df, ["a"], "y", "t", search)
    monkeypatch.setattr(md, "storage_bytes", lambda _: 60 * 300)
    assert md.random_search(df, ["a"], "y", "t", search)[0] == plenty
    assert used == [2, 2, 1, 1]
    assert md.kept_bytes(1, "boosting", search) == 2 * md.kept_bytes(1, "boosting")
