"""Damage to stored files is named by file, and only what a damaged file held is brought back."""

import pytest

from palimpsest.store import Store


@pytest.fixture
def store(spark, tmp_path):
    for part in ("one", "two"):
        folder = tmp_path / "notes" / part
        folder.mkdir(parents=True)
        for i in range(4):
            (folder / f"{i}.md").write_text(f"note {part} {i} about the zebra and what else lives on the plain")
    store = Store(spark, str(tmp_path / "store"))
    for part in ("one", "two"):
        store.index_all([{"name": part, "type": "markdown", "path": str(tmp_path / "notes" / part)}])
    return store


def damage(tmp_path, version, change):
    """Change one file with rows, and let Hadoop's own checksum of it go."""
    folder = tmp_path / "store" / "drawers" / version
    file = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_size)
    change(file)
    (folder / f".{file.name}.crc").unlink(missing_ok=True)
    return str(file)


def flip(file):
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 1
    file.write_bytes(bytes(data))


def test_whole_files(store):
    assert store.damaged() == [] and store.check() == {}


@pytest.mark.parametrize("change, reason", [(flip, "other bytes"), (lambda f: f.write_bytes(f.read_bytes()[:-9]), "bytes, not"), (lambda f: f.unlink(), "missing")])
def test_a_damaged_file_is_named(store, tmp_path, change, reason):
    file = damage(tmp_path, "v2", change)
    ((name, why),) = store.damaged()
    assert name == file and reason in why and list(store.check()) == ["drawers"]


def test_only_what_is_lost_comes_back(store, spark, tmp_path):
    rows = sorted(r["drawer_uid"] for r in store.read("drawers").collect())
    store.snapshot(str(tmp_path / "copy"))
    damage(tmp_path, "v2", flip)
    assert list(store.rebuild(str(tmp_path / "copy"))) == ["drawers"] and store.check() == {}
    assert sorted(r["drawer_uid"] for r in store.read("drawers").collect()) == rows


def test_without_a_snapshot_the_next_run_fills_the_gap(store, tmp_path):
    rows = sorted(r["drawer_uid"] for r in store.read("drawers").collect())
    damage(tmp_path, "v2", flip)
    store.rebuild()
    left = store.read("drawers").count()
    assert 4 <= left < 8 and store.check() == {}
    store.index_all([{"name": p, "type": "markdown", "path": str(tmp_path / "notes" / p)} for p in ("one", "two")], quick=True)
    assert sorted(r["drawer_uid"] for r in store.read("drawers").collect()) == rows
    assert store.searcher().search("zebra", limit=50).count() == 8
