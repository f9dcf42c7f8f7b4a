import struct

import pytest

from terrane.sources import mesh, report


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_obj(spark, tmp_path):
    p = tmp_path / "a.obj"
    p.write_text("# c\nv 0 0 0\nv 1 0 0\nvn 0 0 1\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\nf -4 -3 -2\n")
    v, f = mesh.read_mesh(spark, str(p))
    assert rows(v, "id") == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0)]
    assert rows(f, "f") == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 1, 2)]


def test_off(spark, tmp_path):
    p = tmp_path / "a.off"
    p.write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0 # x\n3 0 1 2\n")
    v, f = mesh.read_mesh(spark, str(p))
    assert v.count() == 3 and rows(f, "f") == [(0, 0, 1, 2)]


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, form):
    head = f"ply\nformat {form} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n".encode()
    vs, end = [(0, 0, 0), (1, 0, 0), (0, 1, 0)], "<" if "little" in form else ">"
    body = ("\n".join(" ".join(map(str, v)) for v in vs) + "\n3 0 1 2\n").encode() if form == "ascii" else b"".join(struct.pack(end + "fff", *v) for v in vs) + struct.pack(end + "Biii", 3, 0, 1, 2)
    p = tmp_path / "a.ply"
    p.write_bytes(head + body)
    v, f = mesh.read_mesh(spark, str(p))
    assert rows(v, "id") == [(i, *map(float, x)) for i, x in enumerate(vs)] and rows(f, "f") == [(0, 0, 1, 2)]
    mesh.write_ply(v, str(tmp_path / "out"))
    assert [r.path.rsplit("/", 1)[1] for r in mesh.list_shapes(spark, str(tmp_path)).collect()] == ["a.ply"]
    with pytest.raises(ValueError):
        mesh.read_mesh(spark, "x.stl")


def test_reports(spark, tmp_path):
    t = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0), ("b", "m", 3.0)], "experiment string, metric string, value double")
    report.write_timing(t, str(tmp_path / "t"), True)
    report.write_timing(t, str(tmp_path / "t"), False)
    assert report.read_timing(spark, str(tmp_path / "t"), ["m", "n"]).count() == 4
    report.write_latex(spark.createDataFrame([("a", "1")], "x string, y string"), str(tmp_path / "l"))
    assert "a & 1 \\\\" in [r.value for r in spark.read.text(str(tmp_path / "l")).collect()]
