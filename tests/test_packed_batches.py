"""Catalogues of very many small batches."""
from pathlib import Path

from framelake.sources import readers as R


def test_packed_batches(spark, tmp_path):
    """A line is a batch file: its name, a tab, its JSON, whose own tabs and line ends are escaped."""
    (tmp_path / "part-0").write_text('catalog-1.json\t{"items": [{"id": "a", "notes": "x\\ty\\nz"}, {"id": "b"}]}\n\t[{"id": "d"}]\n')
    (tmp_path / "part-1").write_text('/p/catalog-2.json\t[{"id": "c", "start_s": 1.5}]\n')
    got = sorted(((r.origin or "", r.id, r.notes) for r in R.read_packed_batches(spark, str(tmp_path)).collect()))
    assert got == [("", "d", None), ("catalog-1", "a", "x\ty\nz"), ("catalog-1", "b", None), ("catalog-2", "c", None)]


def test_files_do_not_follow_batches(spark, tmp_path):
    """SRC-03 writes a file per partition, not one per batch."""
    import __spark_entry__ as entry
    from framelake.session import checkpoint_dir
    folders = lambda: set(Path(checkpoint_dir(spark).removeprefix("file:")).glob("catalog-*"))
    before = folders()
    assert entry.queries()["SRC-03"](spark, "/root/testdata/sf0.001").count() > 0
    (new,) = folders() - before
    assert len([f for f in new.rglob("part-*")]) <= 16
