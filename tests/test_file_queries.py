"""Queries that write files, on tables whose files don't fit at one time."""

from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from shoebox.plans import file_queries, registry
from shoebox.sources import files
from shoebox.sources.driver import Driver

SF = "/root/testdata/sf0.001"
WAVE = 2 << 20
QUERIES = ["k17_copies", "s13_head_and_tail", "k18_k19_backups", "s14_tail_window", "s12_header_bytes"]


@pytest.mark.parametrize("name", QUERIES)
def test_waves(spark, tmp_path, monkeypatch, name):
    """The whole result from several waves, of which one is on disk at a time and none at the end."""
    there, remove, made = [], Driver.remove, iter(range(10_000))

    def watched(self, path):
        there.append(sum(p.stat().st_size for p in tmp_path.rglob("*.bin")))
        remove(self, path)

    monkeypatch.setattr(file_queries, "WAVE_BYTES", WAVE, raising=False)
    monkeypatch.setattr(Driver, "remove", watched, raising=False)
    monkeypatch.setattr(Driver, "workspace", lambda self: f"file://{tmp_path}/{next(made)}")
    df = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(registry.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(tuple(r) for r in df.select(columns).collect()) == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())
    assert not list(tmp_path.rglob("*.bin"))
    total = sum(r[0] for r in con.sql(f"SELECT {file_queries._LENGTH} FROM (SELECT s_suppkey AS s FROM supplier)").fetchall())
    assert len(there) > 2 and max(there) < 2 * total


@pytest.mark.parametrize("name", [x for x in QUERIES if x.startswith("s")])
def test_waves_write_what_is_read(spark, tmp_path, monkeypatch, name):
    """A wave's folder holds media files only, and the driver makes no other: each costs a process beside its memory."""
    held, made, remove, folder, places = [], [], Driver.remove, Driver.folder, iter(range(10_000))

    def watched(self, path):
        held.append({p.name for p in Path(path.removeprefix("file://")).iterdir()})
        remove(self, path)

    monkeypatch.setattr(file_queries, "WAVE_BYTES", WAVE)
    monkeypatch.setattr(Driver, "remove", watched)
    monkeypatch.setattr(Driver, "folder", lambda self, path: made.append(path) or folder(self, path))
    monkeypatch.setattr(Driver, "workspace", lambda self: f"file://{tmp_path}/{next(places)}")
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert len(held) > 2 and set().union(*held) == {"files"} and not made


@pytest.mark.parametrize("name", QUERIES)
def test_no_files(spark, tmp_path, name):
    for t in ("supplier", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.queries()[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", [x for x in QUERIES if x.startswith("s")])
def test_joins_hold_no_contents(spark, monkeypatch, name):
    """A window's bytes aren't joined, as a small side of a join goes through the driver."""
    plans, windows, frame = [], files.windows, type(spark.range(0))

    def joined(self, other, *more, f=frame.join):
        plans.extend(kind for df in (self, other) for _, kind in df.dtypes)
        return f(self, other, *more)

    monkeypatch.setattr(files, "windows", lambda *a: plans.append("read") or windows(*a))
    monkeypatch.setattr(frame, "join", joined)
    registry.queries()[name](spark, SF)
    assert "read" in plans and "string" in plans and "binary" not in plans


@pytest.mark.parametrize(("head", "tail"), [(0, files.TAIL), (files.HEADER, 0)])
def test_batches_of_windows(spark, tmp_path, head, tail):
    """A task hands its windows on in small batches, however many files it reads, and loses none."""

    class Frame:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    sizes = {f"{tmp_path}/{k}.bin": k * 40_000 for k in range(50)}
    for path, n in sizes.items():
        Path(path).write_bytes(bytes(range(250)) * (n // 250))
    batches = list(files.windows(Frame(), head, tail)([pa.RecordBatch.from_pydict({"path": list(sizes)})]))
    assert max(b.nbytes for b in batches) < (4 << 20) + head + tail + 10_000
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["path"], r["length"]) for r in rows] == list(sizes.items())
    for r in rows:
        content = Path(r["path"]).read_bytes()
        assert (r["head"], r["tail"]) == (content[:head], content[max(0, len(content) - tail) :])
