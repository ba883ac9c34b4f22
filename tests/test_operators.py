"""Generation, noise, prediction, scoring and statistics on small tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import domains, generate, noise, predict, score, serialize, stats
from fieldglass.plans import queries, report
from fieldglass.sources import records

TEXT = "Vendor: Blue Shop 12\nDate: 14/03/2024\nTotal: 1,234.50\n\nMode: Credit Card"


def noised(spark, tag, text=TEXT, n=40):
    rows = spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit(text).alias("t"))
    return [r["o"] for r in rows.select(noise.apply(tag, F.col("t"), F.col("k")).alias("o")).collect()]


@pytest.mark.parametrize("tag", [*noise.FUNCTIONS, *noise.BY_DOMAIN])
def test_noise_is_deterministic_and_survives_empty_text(spark, tag):
    got = noised(spark, tag)
    assert got == noised(spark, tag) and all(g is not None for g in got)
    assert all(g is not None for g in noised(spark, tag, "", 3)) and all(g is not None for g in noised(spark, tag, "no label", 3))


def test_noise_effects(spark):
    assert all(len(x) == len(TEXT) and x != TEXT for x in noised(spark, "char_sub"))
    assert all(x.split("\n")[0].startswith("Vendor:") for x in noised(spark, "char_sub"))
    assert all(len(TEXT) - len(x) == 2 for x in noised(spark, "char_del"))  # dates and amounts have no letters
    assert all(sorted(x) == sorted(TEXT) for x in noised(spark, "char_transpose"))
    assert all(sorted(x) == sorted(TEXT) for x in noised(spark, "value_swap"))
    assert all(x.count("\n") in (2, 3) for x in noised(spark, "merged_lines"))
    assert all(x.count("\n") == 5 for x in noised(spark, "split_line"))
    assert all(x.count("\n") == 5 for x in noised(spark, "conflicting_field"))
    assert set(noised(spark, "num_comma_drop")) == {TEXT.replace("1,234", "1234")}
    assert {x.split("\n")[2] for x in noised(spark, "num_decimal_shift")} == {"Total: 1,2345.00", "Total: 1,23.45"}
    assert len({x.split("\n")[1] for x in noised(spark, "date_format_vary", n=200)}) >= 6


def test_selection_follows_counts_and_domains(spark):
    rows = spark.createDataFrame([(d, str(i)) for d in domains.DIFFICULTIES for i in range(60)], "d string, k string")
    for r in rows.select("d", noise.select(F.col("d"), "receipts", F.col("k")).alias("t")).collect():
        for tier, (low, high) in enumerate(domains.NOISE_COUNTS[r["d"]]):
            assert low <= sum(t in domains.NOISE_WEIGHTS[tier] for t in r["t"]) <= high
        first = [t for t in r["t"] if t in domains.NOISE_WEIGHTS[0]]
        assert len(set(first)) == len(first) and not {"char_B8", "merged_lines", "split_line", "ghost_value"} & set(r["t"])


def test_records_and_text(spark):
    for d in domains.DOMAINS:
        rows = generate.records(spark, d, 40)
        assert rows.collect() == generate.records(spark, d, 40).collect()
        due = {f.path for f in domains.fields(d) if f.required}
        for r in rows.withColumn("t", serialize.serialize(F.col("gt"), d, F.col("id"))).collect():
            assert due <= set(r["gt"]) and len([x for x in r["t"].split("\n") if x]) == len(r["gt"])


def test_split_and_manifest(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("receipts").alias("domain"), F.lit("easy").alias("difficulty"))
    row = generate.manifest(generate.split(rows, ["domain", "difficulty"], F.col("id"))).head()
    assert (row["train"], row["dev"], row["test"], row["total"]) == (30, 10, 10, 50)


def test_samples_round_trip(spark, tmp_path):
    rows = generate.records(spark, "receipts", 20).withColumns({"difficulty": F.lit("easy"), "track": F.lit("synthetic"), "split": F.lit("dev"), "task": F.lit("schema"), "noise_tags": F.array(F.lit("a"), F.lit("b")), "raw_text": F.lit("x"), "ocr_text": F.lit("x")}).drop("row")
    path = str(tmp_path / "samples")
    records.write_samples(rows, path)
    assert records.read_samples(spark, path, domain="receipts", noise_tags=["b"]).count() == 20
    assert records.read_samples(spark, path, noise_tags=["b", "c"]).count() == 0 and records.read_samples(spark, path, n=5).count() == 5
    for bad in ({"domain": "x"}, {"split": "x"}, {"n": 21}):
        with pytest.raises(ValueError):
            records.read_samples(spark, path, **bad)
    with pytest.raises(FileNotFoundError):
        records.read_samples(spark, str(tmp_path / "none"))


def test_run_resumes(spark, tmp_path):
    rows = generate.records(spark, "hospital", 6).withColumns({"difficulty": F.lit("easy"), "ocr_text": F.lit("Patient: A B")})
    assert predict.run(spark, rows.limit(2), "R00", str(tmp_path / "run")).count() == 2
    assert predict.run(spark, rows, "R00", str(tmp_path / "run"), resume=True).count() == 6
    with pytest.raises(ValueError):
        predict.model_settings("R99")
    with pytest.raises(ValueError):
        predict.predictor("none")


def test_calls_are_tried_again():
    waits, tries = [], []

    def backend(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise RuntimeError("429 rate limit")
        return "ok"

    assert predict.call(backend, "p", sleep=waits.append).text == "ok" and waits == [2.0, 4.0]
    failed = predict.call(lambda p: 1 / 0, "p", sleep=waits.append)
    assert not failed.success and failed.text == "" and "ZeroDivision" in failed.error


def test_pluggable_model(spark):
    rows = generate.records(spark, "receipts", 3).withColumns({"task": F.lit("schema"), "ocr_text": F.lit("x")})
    assert {r["model_output"] for r in predict.predict(rows, lambda: lambda prompt: str("x" in prompt), "m", "own").collect()} == {"True"}


def scored(spark, answer, gt, text="Vendor: Blue Shop", domain="receipts"):
    rows = spark.createDataFrame([("1", domain, "easy", answer, gt, text)], "id string, domain string, difficulty string, model_output string, gt map<string,string>, ocr_text string")
    return score.evaluate(rows).head()


GT = {"vendor_name": "Blue Shop", "date": "2024-03-14", "total_amount": "100.0", "currency": "INR"}


def test_scores(spark):
    right = scored(spark, '{"vendor_name": "blue shop", "date": "14/03/2024", "total_amount": 100, "currency": "Rs"}', GT)
    assert right["field_f1"] == right["exact_match_rate"] == right["schema_valid"] == 1 and right["failure_modes"] == []
    empty = scored(spark, "{}", GT)
    assert (empty["field_f1"], empty["mean_ned"], empty["schema_valid"], empty["optional_f1"]) == (0, 1, 0, 0)
    failed = scored(spark, "nothing", GT)
    assert failed["parse_success"] == 0 and "parse_failure" in failed["failure_modes"] and failed["schema"]["n_violations"] == 1
    near = scored(spark, '{"vendor_name": null, "total_amount": 100.5, "odd": "zzzz qqqq"}', GT)
    assert near["numeric_tolerance_rate"] == 1 and near["n_pred_fields"] == 3 and near["hallucinated_fields"] == ["odd", "total_amount"]  # a wrong amount that the text lacks, too
    assert set(near["schema"]["violations"]) == {"unknown odd", "missing date", "missing currency"}


def test_bootstrap_and_tests(spark):
    rows = spark.createDataFrame([(str(i), "a", float(i % 7)) for i in range(60)] + [("x", "b", 2.0)], "id string, g string, v double")
    got = {r["g"]: r for r in stats.bootstrap(rows, "v", ["g"], resamples=200).collect()}
    assert got["a"]["lower"] <= got["a"]["mean"] <= got["a"]["upper"] and got["a"]["lower"] < got["a"]["upper"]
    assert got["b"]["lower"] == got["b"]["upper"] == 2.0
    pairs = [(str(i), "shift", 0.5 + 0.01 * i, 0.4 + 0.01 * i) for i in range(20)] + [(str(i), "tie", 1.0, 1.0) for i in range(20)] + [(str(i), "few", 1.0 * i, 0.5) for i in range(5)]
    found = {r["m"]: r for r in stats.wilcoxon(spark.createDataFrame(pairs, "id string, m string, a double, b double"), ["m"]).collect()}
    n = 20
    z = (0 - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert found["shift"]["z"] == pytest.approx(z, abs=1e-4) and found["shift"]["significant"] and found["shift"]["p"] == pytest.approx(math.erfc(-z / math.sqrt(2)), abs=1e-4)
    assert (found["tie"]["p"], found["tie"]["n"], found["few"]["z"]) == (1.0, 0, None)


def test_signed_ranks_of_two_million_pairs(spark):
    n = 2_000_000
    found = stats.wilcoxon(spark.range(n).select(F.lit("m").alias("m"), (F.col("id") % 4 + 1).cast("double").alias("a"), F.lit(3.5).alias("b")), ["m"]).head()
    # differences -2.5, -1.5, -0.5 and 0.5, a quarter each: the positive ones share the lowest ranks
    w = n // 4 * (n // 2 + 1) / 2
    z = (w - n * (n + 1) / 4) / math.sqrt(float(n) * (n + 1) * (2 * n + 1) / 24)
    assert (found["n"], found["w"], found["significant"]) == (n, w, True) and found["z"] == pytest.approx(z, abs=1e-4)


def test_runs_round_as_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.range(20_000).select(F.col("id").alias("s_suppkey"), (F.col("id") / 2 + 0.01 * (F.col("id") % 3)).alias("s_acctbal"))
    rows.write.parquet(f"{tmp_path}/supplier.parquet")
    a, b = queries._runs(spark, str(tmp_path))
    got = sorted(map(tuple, a.withColumnsRenamed({"near": "near_a", "far": "far_a"}).join(b, "id").select("id", "near_a", "near", "far_a", "far").collect()))
    sql = f"""WITH x AS (SELECT s_suppkey AS id, abs(s_acctbal) / 10000 AS x, s_suppkey % 7 / 100 AS e FROM '{tmp_path}/supplier.parquet/*.parquet')
        SELECT id, round(x, 4), round(x + e - 0.03, 4), round(x / 2, 4), round(x / 2 + 0.3 + e, 4) FROM x ORDER BY id"""
    assert got == duckdb.sql(sql).fetchall()


def test_scores_of_doubled_totals_match_their_sql(spark, tmp_path):
    """25999.9 and the 2,999.9 in 12,999.95 have six of seven places in common."""
    duckdb = pytest.importorskip("duckdb")
    totals = [12999.95, 24999.95, 49999.95, 124999.95, 375999.95, 1234.5, 20000.0, 4321.12]
    keys = [5 * i + 1 for i in range(len(totals))] + [5 * i + 3 for i in range(len(totals))]
    orders = [(k, 7, datetime.date(1995, 3, 1 + i), t) for i, (k, t) in enumerate(zip(keys, totals * 2, strict=True))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "Customer#000000007")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for name in ("orders", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("agg_field_scores", "agg_failure_modes"):
        due = db.sql(queries.SQL[name])
        got = queries.QUERIES[name](spark, str(tmp_path)).select(*due.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, due.fetchall()))


def test_scores_of_totals_with_exponents_match_their_sql(spark, tmp_path):
    """Spark writes doubles from ten million with an exponent, in the truth and in the answer's JSON."""
    duckdb = pytest.importorskip("duckdb")
    totals = [5000000.0, 6543210.5, 9999999.99, 10000000.0, 12345678.9, 12999999.95, 123456789012.34]
    orders = [(20 * i + k, 7, datetime.date(1995, 3, 1 + i), t) for i, t in enumerate(totals) for k in range(5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "Customer#000000007")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for name in ("orders", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("agg_failure_modes", "agg_field_scores", "agg_field_maps"):
        due = db.sql(queries.SQL[name])
        got = queries.QUERIES[name](spark, str(tmp_path)).select(*due.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, due.fetchall()))


def test_summary_levels_and_reports(spark):
    rows = spark.createDataFrame([("r", "easy", 1.0), ("r", "hard", 3.0), ("i", "easy", None)], "domain string, difficulty string, m double")
    got = stats.summarize(rows, ["m"])
    assert {(r["level"], r["n"]) for r in got.collect()} == {("overall", 2), ("domain", 2), ("difficulty", 1), ("domain_x_difficulty", 1)}
    assert "<td>m</td>" in report.html_report(got, "t", ["easy", "hard"], "m") and '"m": 2.0' in report.summary_json(got, "R01", "x")
    runs = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", None)], "run_id string, exact_match_rate double")
    assert report.leaderboard_markdown(runs, ["exact_match_rate"]).split("\n")[2].startswith("| b")
    assert "█" in report.bars({"a": 0.5}, "t") and report.score_class(0.9) == "good" and report.score_class(0.2, False) == "poor" and "svg" in report.svg_bars({"a": (0.5, 0.4, 0.6)})


def test_settings_hold(spark):
    assert all(r["ok"] for r in domains.checks(spark).collect()) and len(domains.fields()) == 43


def test_streams(spark, tmp_path):
    from fieldglass.streaming import scoring

    rows = spark.createDataFrame([(str(i), "receipts", "easy", "{}", GT, "x") for i in (1, 2, 2)], "id string, domain string, difficulty string, model_output string, gt map<string,string>, ocr_text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize(
    ("number", "results"),
    [("1.123456789", {"11.234567890", "0.112345679"}), ("123456789012345678901234567.50", {"1234567890123456789012345675.00", "12345678901234567890123456.75"}), ("0.5", {"5.0", "0.1"}), ("99.99", {"999.90", "10.00"}), ("007.0", {"70.0", "0.7"})],
)
def test_points_move_in_numbers_of_any_length(spark, number, results):
    assert set(noised(spark, "num_decimal_shift", f"Total: {number}")) == {f"Total: {r}" for r in results}


def test_settings_with_faults_are_found(spark, tmp_path):
    broken = domains.Settings(required={"receipts": ["colour"]}, splits={"train": 1.5}, rates={})
    assert domains.run_checks() == 0 and domains.run_checks(broken) == 1
    assert {name for name, ok, _ in domains.found_faults(broken) if not ok} == {"required_fields", "splits", "noise_rates"}
    (tmp_path / "s.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        domains.load_settings(spark, str(tmp_path / "s.json"))


def test_files_are_found_by_name(spark, tmp_path):
    for folder, name in (("receipts", "receipts_easy_dev"), ("receipts", "receipts_hard_dev"), ("hospital", "hospital_easy_test")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    names = lambda found: [f.rsplit("/", 1)[1] for f in found]
    assert names(records.discover(spark, str(tmp_path), split="dev")) == ["receipts_easy_dev.jsonl", "receipts_hard_dev.jsonl"]
    assert names(records.discover(spark, str(tmp_path), domain="hospital")) == ["hospital_easy_test.jsonl"] and records.discover(spark, str(tmp_path), domain="insurance") == []
    assert records.read_lines(spark, records.discover(spark, str(tmp_path), difficulty="hard")).count() == 2 and records.read_lines(spark, []).count() == 0
    (tmp_path / "vision").mkdir()
    (tmp_path / "vision" / "receipts_easy_dev.jsonl").write_text('{"id": "3"}\n')  # without folders by domain
    assert names(records.discover(spark, str(tmp_path), track="real_ocr")) == ["receipts_easy_dev.jsonl"]
    for bad in ({"domain": "x"}, {"track": "x"}):
        with pytest.raises(ValueError):
            records.discover(spark, str(tmp_path), **bad)
    with pytest.raises(FileNotFoundError):
        records.discover(spark, str(tmp_path / "none"))


def test_last_record_of_an_id_counts(spark):
    rows = spark.createDataFrame([("1", 1, 0.5), ("1", 2, 0.25), ("2", 1, None)], "id string, place int, m double")
    got = {r["id"]: (r["a"], r["b"]) for r in stats.paired(rows, rows, ["m"], order_col="place").collect()}
    assert got == {"1": (0.25, 0.25)}
    assert {r["id"]: r["a"] for r in stats.paired(rows, rows, ["m"]).collect()} == {"1": 0.5}


def test_large_groups_draw_by_joins(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else None, float(i * i % 17)) for i in range(40)], "id int, g string, v double")
    small, large = (sorted(map(tuple, stats.bootstrap(rows.where("g IS NOT NULL"), "v", ["g"], resamples=50, most=most).collect())) for most in (100, 5))
    assert small == large
    assert stats.bootstrap(rows, "v", [], resamples=20).count() == 1 and stats.bootstrap(rows, "v", ["g"], resamples=20).count() == 2


def test_runs_need_a_client_and_leave_out_limits(spark, tmp_path):
    rows = generate.records(spark, "receipts", 4).withColumns({"difficulty": F.lit("easy"), "task": F.lit("schema"), "ocr_text": F.col("id")})
    with pytest.raises(ValueError):
        predict.run(spark, rows, "R06", str(tmp_path / "a"))

    def client():
        def ask(prompt):
            if prompt.endswith("2"):
                raise RuntimeError("quota used up")
            return "{}"

        return ask

    assert {r["id"][-1] for r in predict.run(spark, rows, "R06", str(tmp_path / "a"), make_backend=client).collect()} == {"0", "1", "3"}
    again = predict.run(spark, rows, "R06", str(tmp_path / "a"), resume=True, make_backend=lambda: lambda p: "again")
    assert {r["id"][-1]: r["model_output"] for r in again.collect()} == {"0": "{}", "1": "{}", "2": "again", "3": "{}"}
    assert records.read_run_config(spark, str(tmp_path / "a"))["model"] == "llama3.2"


def test_report_of_a_run(spark, tmp_path):
    rows = generate.records(spark, "receipts", 6).withColumn("difficulty", F.when(F.col("row") < 3, "easy").otherwise("hard"))
    rows = rows.withColumn("ocr_text", serialize.serialize(F.col("gt"), "receipts", F.col("id")))
    found = score.evaluate(predict.regex_rules(rows))
    compared = stats.compare(found, score.evaluate(predict.always_null(rows)), ["field_f1"], resamples=30)
    page = report.report(spark, found, str(tmp_path), {"model": "m<1>", "filters": {"split": "dev"}}, compared, resamples=30)
    assert (tmp_path / "report.html").read_text() == page and "m&lt;1&gt;, dev" in page
    for part in ("Scores", "Failure modes", "Domain by difficulty", "svg_comparison", "Comparison", "rec_000005"):
        assert part in page
    assert set(report.write_summary(spark, found, str(tmp_path), {"model": "m"})["metrics"]) == set(report.SUMMARY)


def test_groups_by_task(spark):
    rows = spark.createDataFrame([("a", "x", "t", 1.0), ("a", "x", None, 3.0)], "domain string, difficulty string, task string, m double")
    assert {(r["group"], r["mean"]) for r in stats.summarize_by(rows, ["m"], ["task", "domain_x_difficulty"]).collect()} == {("t | a__x", 1.0), ("unknown | a__x", 3.0)}
    assert stats.summarize_by(rows, ["m"], ["overall"]).head()["n"] == 2
    with pytest.raises(ValueError):
        stats.group_key(["city"])


def test_clients_ask_and_read_each_kind():
    from fieldglass.operators import backends

    answers = {
        "/v1/chat/completions": {"choices": [{"message": {"content": "A"}}]}, "/v1/messages": {"content": [{"type": "text", "text": "A"}]},
        "/api/generate": {"response": "A"}, "/completion": {"content": "A"},
    }
    asked = []

    def post(url, body, headers, timeout):
        asked.append((url, body, headers))
        return answers[url.removeprefix("http://here")]

    for run_id in ("R02", "R03", "R04"):
        settings = predict.model_settings(run_id, max_tokens=7)
        assert backends.client(settings, "http://here/", "key", post=post)()("hello") == "A"
    assert backends.client({"backend": "llama_cpp", "name": "m", "temperature": 0, "max_tokens": 7}, "http://here", post=post)()("hello") == "A"
    assert len(asked) == 4 and all("hello" in str(body) and 7 in (body.get("max_tokens"), body.get("n_predict"), body.get("options", {}).get("num_predict")) for _, body, _ in asked)
    assert asked[1][2] == {"Authorization": "Bearer key"} and asked[0][2] == {}
    with pytest.raises(ValueError):
        backends.client(predict.model_settings("R03"), "http://here")
    with pytest.raises(ValueError):
        backends.client(predict.model_settings("R01"), "http://here")
    with pytest.raises(ValueError):
        predict.check_template("{SCHEMA}")
