"""Files in batch and as a stream give the same documents and chunks."""

from sprachwerk.operators import retrieve
from sprachwerk.sources import files, store
from sprachwerk.streaming import ingest


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("# Vertrag\n\n§ 7 Kündigung\nDie Kündigungsfrist ist drei Monate.", encoding="utf-8")
    (folder / "sub" / "b.txt").write_bytes("Größe\r\nzwei".encode("cp1252"))
    (folder / "c.log").write_bytes(b"")
    (folder / "d.txt").write_bytes(b"\x81\xff")
    (folder / "e.bin").write_bytes(b"no")
    rows = {r["title"]: r for r in files.read(spark, str(folder)).collect()}
    assert set(rows) == {"Vertrag", "b", "d"}
    assert rows["b"]["text"] == "Größe\nzwei" and rows["d"]["text"] is None and rows["d"]["error"]
    s = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # nothing new the second time
        ingest.ingest(files.read_stream(spark, str(folder)), s, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert s.read("documents").count() == 3
    asked = spark.createDataFrame([(1, "Kündigungsfrist")], "qid int, question string")
    assert "drei Monate" in retrieve.Index(s.read("chunks")).search(asked, 1).first()["content"]
