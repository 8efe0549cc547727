import pyarrow as pa
import pytest

from tidegauge.sources import store, text


def _rows(spark, a, b, step=10):
    return spark.createDataFrame([("s", t, float(t), 0.0, 1.0, 1) for t in range(a + step, b + 1, step)], store.KINDS["buckets"])


def test_datasets_are_written_once(spark, tmp_path):
    st = store.DatasetStore(spark, str(tmp_path))
    st.put("buckets", "d-1", _rows(spark, 0, 50).unionByName(_rows(spark, 0, 50)))
    assert st.get("buckets", "d-1").count() == 5 and st.interval("buckets", "d-1") == (10, 50)
    assert [r["ts_ms"] for r in st.get("buckets", "d-1", 20, 40).orderBy("ts_ms").collect()] == [30, 40]
    with pytest.raises(ValueError, match="immutable"):
        st.put("buckets", "d-1", _rows(spark, 0, 10))
    with pytest.raises(ValueError):
        st.put("buckets", "../x", _rows(spark, 0, 10))


def test_cache_fetches_what_it_lacks(spark, tmp_path):
    cache, asked = store.SeriesCache(spark, str(tmp_path), ttl_ms=100, settle_ms=50), []
    size = 10 * store.CHUNK_BUCKETS

    def fetch(complete=True):
        def run(a, b):
            asked.append(a)
            return _rows(spark, a, b, size // 4), complete

        return run

    assert cache.get("q", 0, 2 * size, 10, 2 * size, fetch()).count() == 8 and asked == [0, size]
    cache.get("q", 0, 2 * size, 10, 2 * size + 90, fetch())
    assert asked == [0, size]  # one final, one fresh
    cache.get("q", 0, 2 * size, 10, 2 * size + 200, fetch(False))
    assert asked == [0, size, size] and cache.peek("q", 0, 2 * size, 10).count() == 8  # the partial answer is not kept
    cache.get("q", size, 2 * size, 10, 2 * size + 300, fetch())
    cache.get("q", size, 2 * size, 10, 9 * size, fetch())
    assert asked == [0, size, size, size] and cache.peek("other", 0, 10, 10).count() == 0


def test_arrow_exchange(spark, tmp_path):
    store.exchange({"t": _rows(spark, 0, 30)}, str(tmp_path / "run"), {"v": 1})
    assert store.read_arrow(str(tmp_path / "run" / "t.arrow")).num_rows == 3 and (tmp_path / "run" / "meta.json").exists()
    store.write_arrow(pa.table({"x": [1]}), str(tmp_path / "x.arrow"))
    assert not (tmp_path / "x.arrow.part").exists()
    with pytest.raises(ValueError):
        store.exchange({"t": _rows(spark, 0, 30)}, str(tmp_path / "two"), {}, max_rows=2)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,x,y\n1700000000,1,\n2023-11-14T22:13:21Z,2.5,3\n")
    rows = {(r["ts_ms"], r["column"], r["value"]) for r in text.csv_table(spark, str(tmp_path / "a.csv"), 0).collect()}
    assert rows == {(1700000000000, "x", 1.0), (1700000001000, "x", 2.5), (1700000001000, "y", 3.0)}
    (tmp_path / "b.csv").write_text("x\nword\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.csv_table(spark, str(tmp_path / "b.csv"), 0).collect()


def test_inline_and_lines(spark):
    assert text.inline(spark, [{"label": "a", "ts": [0, 30], "values": [1, 2]}, {"label": "b", "ts": [45], "values": [1]}])[1] == 15
    with pytest.raises(ValueError):
        text.inline(spark, [{"label": "a", "ts": [0, 0], "values": [1, 2]}])
    with pytest.raises(Exception, match="cannot parse"):
        text.exposition(spark.createDataFrame([("9x 1",)], "value string"), 0).collect()
