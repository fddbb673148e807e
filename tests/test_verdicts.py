"""The registered verdict queries judge every event."""

from datetime import datetime

from terrane.queries import QUERIES


def test_verdicts_count_events_of_every_value(spark, tmp_path):
    early, late = datetime(2024, 1, 2), datetime(2024, 1, 20)
    rows = [(1, "view", 1.5, early), (1, "click", 2.5, early), (1, "click", 4.0, late), (2, "view", 3.0, early), (2, "error", 5.0, late)]
    frame = spark.createDataFrame(rows, "user_id long, event_type string, value double, ts timestamp_ntz")
    frame.write.parquet(str(tmp_path / "events.parquet"))
    found = {r.user_id: (r.targeted, r.removed, r.new, r.valid) for r in QUERIES["patch_verdict"](spark, str(tmp_path)).collect()}
    assert found == {1: (2, 1, 0, True), 2: (1, 1, 1, False)}
    total = QUERIES["remediation_metrics"](spark, str(tmp_path)).first()
    assert (total.n_files, total.pvr, total.ser_micro, total.nnir) == (2, 0.5, 2 / 3, 0.5)
