import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import regions
from tessera.sources import headers

BOX = "image string, cls int, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, n string"


def overlap(a, b):
    w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
    return w * h, (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h


def greedy(rows, iou):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        if all(k[:2] != r[:2] or not overlap(r, k)[0] > iou * overlap(r, k)[1] for k in kept):
            kept.append(r)
    return sorted((r[2] for r in kept))


@pytest.mark.parametrize("iou", [0.5, 0.3])
def test_rounds_equal_the_greedy_loop(spark, iou):
    rng = np.random.default_rng(int(iou * 100))
    rows = []
    for i in range(130):
        x, y, w, h = rng.uniform(-3, 3, 2).tolist() + (2.0 ** rng.uniform(-2, 2, 2)).tolist()
        rows.append((None if i % 5 == 0 else "a", int(i % 3 > 1), i, x, y, x + w, y + h, float(np.round(rng.random(), 1)), "x"))
    rows += [("a", 0, 300 + i, 0.0, 0.0, 1.0, 1.0, 0.05, "x") for i in range(30)]  # copies
    rows += [("a", 0, 400, 0.5, 0.5, 0.5, 2.0, 0.9, "x"), ("a", 0, 401, 0.5, 0.5, 0.5, 2.0, 0.8, "x")]  # no area
    df = spark.createDataFrame(rows, BOX).repartition(4)
    want = greedy(rows, iou)
    for size in (0, 50, 20_000) if iou == 0.5 else (50,):  # all in rounds, the large groups, none
        got = regions.greedy_nms(df, iou, group_boxes=size)
        assert sorted(r["det_idx"] for r in got.collect()) == want and got.columns == df.columns


def test_rounds_of_a_chain_and_of_nothing(spark):
    """Each box takes the next one away, which so cannot take the one after it."""
    rows = [("a", 0, i, 0.3 * i, 0.0, 0.3 * i + 1, 1.0, 1 - i / 100, "x") for i in range(8)]
    got = regions.nms_in_rounds(spark.createDataFrame(rows, BOX), 0.5)
    assert sorted(r["det_idx"] for r in got.collect()) == greedy(rows, 0.5) == [0, 2, 4, 6]
    assert regions.greedy_nms(spark.createDataFrame([], BOX), group_boxes=0).count() == 0
    with pytest.raises(ValueError):
        regions.nms_in_rounds(spark.createDataFrame(rows, BOX), 0.0)


def test_summed_areas_equal_the_cells(spark):
    rng = np.random.default_rng(1)
    cells = [(g, r, c, None if rng.random() < 0.1 else float(rng.normal())) for g in ("a", "b") for r in range(9) for c in range(7) if rng.random() < 0.8]
    boxes = [("a" if i % 2 else "b", i, *rng.integers(-2, 10, 4).tolist()) for i in range(80)] + [("c", 99, 0, 2, 0, 2)]
    got = regions.box_pool(spark.createDataFrame(cells, "image string, row int, col int, value double"), spark.createDataFrame(boxes, "image string, box_id int, r1 int, r2 int, c1 int, c2 int"))
    want = {}
    for g, i, r1, r2, c1, c2 in boxes:
        inside = [v for k, r, c, v in cells if k == g and r1 <= r < r2 and c1 <= c < c2]
        if inside:
            known = [v for v in inside if v is not None]
            want[g, i] = (len(inside), pytest.approx(np.mean(known)) if known else None)
    assert {(r["image"], r["box_id"]): (r["n"], r["value"]) for r in got.collect()} == want


def test_headers():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4) + (480).to_bytes(4)
    assert headers.image_size(png) == ("png", 640, 480)
    sof = b"\xff\xc2\0\x11\x08" + (33).to_bytes(2) + (44).to_bytes(2)
    app = b"\xff\xe1" + (70).to_bytes(2) + b"\xff\xc0" + b"\0" * 66  # a thumbnail's frame within is not the image's
    assert headers.image_size(b"\xff\xd8" + app + b"\xff\xff" + app[:] + b"\xff\x01" + sof) == ("jpeg", 44, 33)
    top_down = b"BM" + b"\0" * 12 + (40).to_bytes(4, "little") + (5).to_bytes(4, "little") + (-6).to_bytes(4, "little", signed=True)
    assert headers.image_size(top_down) == ("bmp", 5, 6)
    old = b"BM" + b"\0" * 12 + (12).to_bytes(4, "little") + (5).to_bytes(2, "little") + (6).to_bytes(2, "little") + b"\0" * 4
    assert headers.image_size(old) == ("bmp", 5, 6)
    for broken in (None, b"", b"text", png[:20], b"\xff\xd8" + app, b"\xff\xd8\xff\xda" + sof, b"\xff\xd8" + sof[:6], b"RIFF....WEBPVP9 " + b"\0" * 30, b"BM", png[:16] + b"\0" * 8):
        assert headers.image_size(broken) is None


def test_sizes_of_a_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (2).to_bytes(4) + (3).to_bytes(4) + b"rest")
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_bytes(b"")
    got = [tuple(r) for r in headers.folder_sizes(spark, str(tmp_path)).select("name", "format", "width", "height").orderBy("name").collect()]
    assert got == [("a.png", "png", 2, 3), ("b.jpg", None, None, None)]


def test_count_report(spark):
    rows = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 3.0), ("y", "b", None)], "g string, image string, v double")
    got = regions.count_report(rows, "image", "v").first()
    assert (got["n"], got["items"], got["least"], got["most"], got["mean"], got["per_item"]) == (3, 2, 1.0, 3.0, 2.0, 1.5)
    assert regions.count_report(rows, "image", by=("g",)).filter(F.col("g") == "x").first()["per_item"] == 2.0
