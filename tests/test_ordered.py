"""Lines with their places, at every size of ranges, and tables that keep the order of their files."""

import io
import random

import pytest
from small import iot

from sectora.plans.kernels import shared_dir
from sectora.schema import WrongInput
from sectora.sources import ordered


def slow(data):
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        out.append((at, data[at:end].removesuffix(b"\r")))
        at = end + 1
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_ranges_share_out_lines(monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    r = random.Random(5)
    texts = [b"", b"\n", b"a", b"a\n", b"\n\na", b"ab\r\nc\r\n\n"] + ["".join(r.choice("ab\n\né") for _ in range(r.randint(1, 40))).encode() for _ in range(20)]
    for data in texts:
        for split in (1, 2, 7, 100):
            got = []
            for start in range(0, len(data), split):
                for places, lines in ordered.lines_of(io.BytesIO(data), start, min(start + split, len(data))):
                    got += zip(places, lines, strict=True)
            assert got == slow(data), (data, split)


def test_source_in_parallel(spark, tmp_path):
    texts = {"b.txt": "x\nyy\nx\nzzz", "a.txt": "yy\nw\n", "_hidden": "no\n", "empty.txt": ""}
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    rows = ordered.lines(spark, str(tmp_path), 3)
    assert rows.rdd.getNumPartitions() > 2
    got = sorted((r.file.rsplit("/", 1)[1], r.offset, r.value) for r in rows.collect())
    assert got == [("a.txt", 0, "yy"), ("a.txt", 3, "w"), ("b.txt", 0, "x"), ("b.txt", 2, "yy"), ("b.txt", 5, "x"), ("b.txt", 7, "zzz")]
    seen = ordered.first_seen(rows, "value").collect()
    assert {r.value: r.position for r in seen} == {"yy": 0, "w": 1, "x": 2, "zzz": 3}


def test_flat_files_keep_their_order(spark):
    model = iot(spark)
    labels = [r.id for r in model.axis.collect()]
    random.Random(2).shuffle(labels)
    order = spark.createDataFrame(list(zip(labels, range(len(labels)), strict=True)), "id long, position long")
    paths = [f"{shared_dir(spark)}/ordered-{random.random()}" for _ in range(2)]
    ordered.write_flat_in_order(model, order, paths[0])
    again, found = ordered.read_flat_in_order(spark, paths[0], "IOT", units=model.units, split_bytes=200)
    ordered.write_flat_in_order(again, found, paths[1])
    texts = []
    for p in paths:
        rows = ordered.lines(spark, p, 500).filter("offset > 0").orderBy("file", "offset").collect()
        texts.append([r.value for r in rows])
    assert texts[0] == texts[1] and len(texts[0]) == model.cells.count()
    assert again.same_sets(model)
    whole = ordered.read_flat_in_order(spark, paths[0], "IOT", split_bytes=1 << 20)[1]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, found.collect()))
    # the first rows are those of E: its first account has the lowest place
    first = again.axis.join(found, "id").orderBy("position").first()
    assert first.level == "Satellite account"


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Matrix,Value\nZ,1\n")
    (tmp_path / "b.csv").write_text("Value,Matrix\n1,Z\n")
    with pytest.raises(WrongInput):
        ordered.read_flat_in_order(spark, str(tmp_path), "IOT")
