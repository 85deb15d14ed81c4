import pyarrow as pa

from strataspark.sources import blobs


def test_contents_are_written_from_arrow_batches(spark, tmp_path):
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([b"one" * 5, None, b""], pa.binary())], names=["name", "content"])
    writer = blobs._Writer(f"file:{tmp_path}/direct")
    writer.commit([writer.write(iter([batch, batch.slice(3), batch.slice(0, 1)]))])  # batches, not rows in Python's memory as before
    assert (tmp_path / "direct/a").read_bytes() == b"one" * 5 and (tmp_path / "direct/b").read_bytes() == b"" == (tmp_path / "direct/c").read_bytes()
    files = spark.createDataFrame([(f"{k}", bytes([k]) * 1000) for k in range(50)], "name string, content binary")
    blobs.write_files(files, f"{tmp_path}/whole")
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "whole").iterdir() if not p.name.startswith(".")) == sorted((f"{k}", bytes([k]) * 1000) for k in range(50))
