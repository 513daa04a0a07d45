import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows, weekdays
from pairloom.functions.columns import business_days, count_business_days
from pairloom.operators import quality as D
from pairloom.operators import universe as U
from pairloom.params import Period, QualityParams, UniverseParams
from pairloom.sources import landing, tables

DAYS = weekdays("2020-01-01", 5)
P = QualityParams(period=Period(DAYS[0], DAYS[-1]), min_history_days=5, max_missing_fraction=0.1)


def vendor(spark, ticker="AAA", close=("10", "11", "12", "13", "14"), volume=(5, 6, 7, 8, 9), days=DAYS):
    data = [(ticker, d.isoformat(), c, c, c, c, c, str(v), i)
            for i, (d, c, v) in enumerate(zip(days, close, volume))]
    return spark.createDataFrame(data, ["ticker", "Date", "Open", "High", "Low", "Close", "Adj Close", "Volume", "ord"])


def test_clean_data_is_valid(spark):
    row = rows(D.validation_report(vendor(spark), P))[0]
    assert row["valid"] and row["issues"] == "" and row["row_count"] == 5
    assert row["expected_observations"] == 5 and row["missing_observation_fraction"] == 0


def test_defects_are_counted_and_listed_in_order(spark):
    days = [DAYS[0], DAYS[0], *DAYS[2:]]
    raw = vendor(spark, close=("10", "x", "0", "13", "14"), volume=(5, 0, 7, 8, 9), days=days)
    row = rows(D.validation_report(raw, P))[0]
    assert (row["missing_adjusted_close"], row["duplicated_dates"], row["zero_volume_days"],
            row["non_positive_price_rows"], row["row_count"]) == (1, 2, 1, 1, 4)
    assert row["issues"] == (
        "Adjusted close contains missing values.; Duplicated dates detected.; Zero volume days detected.; "
        "Non-positive prices detected.; Only 4 observations available; minimum is 5.; "
        "Missing observation fraction 20.00% exceeds threshold 10.00%.")
    assert not row["valid"] and row["missing_observation_fraction"] == 0.2


def test_ticker_outside_the_period_keeps_its_row(spark):
    row = rows(D.validation_report(vendor(spark, days=weekdays("2019-01-01", 5)), P))[0]
    assert row["row_count"] == 0 and row["start_date"] is None and row["zero_volume_days"] == 0


def test_missing_columns(spark):
    row = rows(D.validation_report(vendor(spark).drop("Volume", "Adj Close"), P))[0]
    assert row["missing_ohlcv_columns"] == "volume"
    assert row["issues"] == "Missing OHLCV columns: volume.; Missing adjusted_close column."


def test_cleaning_keeps_the_last_row_of_a_day(spark):
    days = [DAYS[0], DAYS[0], *DAYS[2:]]
    out = rows(D.clean_bars(vendor(spark, days=days), P), "date")
    assert [r["close"] for r in out] == [11.0, 12.0, 13.0, 14.0]


def test_valid_gate(spark):
    both = vendor(spark).union(vendor(spark, ticker="BAD", volume=(0, 1, 1, 1, 1)))
    assert {r["ticker"] for r in rows(D.valid_bars(both, P))} == {"AAA"}


def test_business_days_agree(spark):
    spans = [("2008-01-01", "2025-12-31"), ("2020-02-29", "2020-02-29"), ("2020-03-01", "2020-03-02")]
    df = spark.createDataFrame([(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in spans], ["a", "b"])
    got = [r["n"] for r in df.select(business_days(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [4697, 0, 1]
    assert [count_business_days(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in spans] == got


def test_universe_audit_reasons(spark):
    listing = spark.createDataFrame(
        [("pass", "P", "Tech", "Soft"), ("low", "L", "Tech", "Soft"), ("none", "N", "Tech", "Soft"),
         ("PASS ", "P2", "Tech", "Soft"), ("", "B", "Tech", "Soft"), ("class", "C", " ", "")],
        ["Ticker", "Company Name", "Sector", "Industry"]).coalesce(1)
    prices = spark.createDataFrame(
        [(t, d, px, 100.0, i) for t, px in (("PASS", 10.0), ("LOW", 1.0), ("CLASS", 10.0))
         for i, d in enumerate(DAYS)], ["ticker", "date", "adjusted_close", "volume", "ord"])
    p = UniverseParams(period=P.period, min_adjusted_close_price=5, min_average_daily_dollar_volume=500,
                       max_missing_data_ratio=0.1, min_history_days=5)
    audit = U.universe_audit(tables.normalize_constituents(listing), prices, p)
    found = {r["row_number"]: (r["ticker"], r["exclusion_reasons"], r["warnings"]) for r in rows(audit)}
    assert found == {
        2: ("PASS", "", ""),
        3: ("LOW", "below_min_adjusted_close_price;below_min_average_daily_dollar_volume", ""),
        4: ("NONE", "missing_processed_price_data", ""),
        5: ("PASS", "duplicate_ticker", ""), 6: ("", "empty_ticker", ""),
        7: ("CLASS", "", "missing_sector;missing_industry")}
    assert {r["ticker"] for r in rows(U.clean_universe(audit))} == {"PASS", "CLASS"}


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        QualityParams(frequency="hourly")
    with pytest.raises(ValueError):
        Period("2020-02-01", "2020-01-01")


def test_price_files_round_trip(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "BRK.B.csv").write_text("Date,Adj Close,Volume\n2020-01-02,10.5,7\n2020-01-02,11.5,bad\n")
    out = rows(tables.read_price_files(spark, str(folder)), "ord")
    assert [(r["ticker"], r["date"].isoformat(), r["adjusted_close"], r["volume"]) for r in out] == [
        ("BRK.B", "2020-01-02", 10.5, 7.0), ("BRK.B", "2020-01-02", 11.5, None)]


def test_scan_rules(spark):
    pairs = spark.createDataFrame([(" aaa", "bbb "), ("", "ccc")], ["Ticker 1", "Ticker-2"])
    assert rows(tables.normalize_selected_pairs(pairs)) == [
        {"ticker_1": "AAA", "ticker_2": "BBB", "pair_id": "AAA-BBB"}]
    flags = spark.createDataFrame([(" Naive ", "Yes", "1"), ("b", "no", "x")],
                                  ["model", "selected_by_validation", "selection_rank"])
    out = rows(tables.normalize_comparison(flags), "selected_by_validation")
    assert [(r["model"], r["selected_by_validation"], r["selection_rank"]) for r in out] == [
        ("b", False, None), ("naive", True, 1.0)]
    with pytest.raises(tables.MissingColumns):
        tables.normalize_signals(pairs)


def test_only_listed_price_files_are_read(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name in ("AAA", "B_B", "CCC"):
        (folder / f"{name}.csv").write_text("Date,Adj Close,Volume\n2020-01-02,10.5,7\n")
    found = tables.read_price_files(spark, str(folder), [" aaa ", "b/b", "ZZZ", ""])
    assert {r["ticker"] for r in found.collect()} == {"AAA", "B_B"}
    assert len(found.inputFiles()) == 2
    none = tables.read_price_files(spark, str(folder), ["ZZZ"])
    assert none.columns == found.columns and none.count() == 0


def test_landing_twice_and_after_a_broken_landing_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "landing")
    days = weekdays("2020-01-01", 6)
    table = lambda data: spark.createDataFrame(data, "ticker string, date date, adjusted_close double, volume double")
    first = [("A", d, 1.0 + i, 5.0) for i, d in enumerate(days[:3])]
    more = [("A", d, 9.0, 6.0) for d in days[2:]] + [("B", days[0], 2.0, 1.0), ("B", days[0], 2.0, 1.0), (None, days[0], 1.0, 1.0)]
    want = {(t, d): p for t, d, p, _ in first}
    assert {(r["ticker"], r["date"]): r["adjusted_close"] for r in landing.land(table(first), root).collect()} == want
    table(more).write.parquet(f"{root}/data/batch=broken")  # no manifest: no reader sees it
    want |= {(t, d): p for t, d, p, _ in more if t and (t, d) not in want}
    for _ in range(2):
        got = landing.land(table(more), root)
        assert got.count() == len(want) and {(r["ticker"], r["date"]): r["adjusted_close"] for r in got.collect()} == want
    assert landing.manifest(spark, root).count() == 2
    late = table([("Z", days[5] + dt.timedelta(days=400), 1.0, 1.0)])
    assert landing.touched(late, root) == [] and landing.touched(table(first), root) != []
    before = landing.land(table([]), root).count()
    assert before == len(want) and landing.land(late, root).count() == before + 1


def test_last_incoming_row_of_a_key_lands(spark, tmp_path):
    rows_ = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 0), ("A", dt.date(2020, 1, 1), 2.0, 1)],
                                  "ticker string, date date, adjusted_close double, ord long")
    assert [r["adjusted_close"] for r in landing.land(rows_, str(tmp_path / "x")).collect()] == [2.0]


def test_row_numbers_follow_a_range_partitioning_with_sampled_borders(spark):
    n = 6000
    listing = spark.range(0, n, 1, 1).select("id", F.col("id").cast("string").alias("ticker"), *[
        F.concat(F.lit(c), "id").alias(c) for c in ("company_name", "sector", "industry")])
    listing = listing.repartitionByRange(4, "id").sortWithinPartitions("id").drop("id")
    got = tables.normalize_constituents(listing).select("ticker", "row_no").collect()
    assert sorted((r["row_no"], int(r["ticker"])) for r in got) == [(i, i) for i in range(n)]
