"""MAT-files made here are read back."""

import struct
import zlib

import numpy as np
import pytest

from gridsignal.sources import files, matfiles


def element(kind, raw, order):
    if 0 < len(raw) <= 4:
        return struct.pack(f"{order}I", len(raw) << 16 | kind) + raw + b"\0" * (4 - len(raw))
    return struct.pack(f"{order}2I", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def array(value, order, name=""):
    """A dict is a structure, a list of dicts an array of them, another list a cell array, a text a text."""
    head = lambda kind, shape: element(6, struct.pack(f"{order}2I", kind, 0), order) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name.encode(), order)
    if isinstance(value, dict):
        value = [value]
    if isinstance(value, list) and value and isinstance(value[0], dict):
        fields = list(value[0])
        body = head(2, (1, len(value))) + element(5, struct.pack(f"{order}i", 32), order) + element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields), order)
        body += b"".join(array(v[f], order) for v in value for f in fields)
    elif isinstance(value, list):
        body = head(1, (1, len(value))) + b"".join(array(v, order) for v in value)
    elif isinstance(value, str):
        body = head(4, (1, len(value))) + element(16, value.encode(), order)
    else:
        data = np.atleast_2d(np.asarray(value, float))
        body = head(6, data.shape) + element(9, data.ravel(order="F").astype(f"{order}f8").tobytes(), order)
    return element(14, body, order)


def mat(variables, order="<", packed=False):
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, value in variables.items():
        one = array(value, order, name)
        blob = zlib.compress(one)
        out += struct.pack(f"{order}2I", 15, len(blob)) + blob if packed else one
    return out


def design(units):
    u = [{"name": ["audio"], "ons": np.array([[1.0], [5.0]]), "dur": np.array([[0.0], [2.0]])}, {"name": ["video"], "ons": np.array([[3.0]]), "dur": np.array([[4.0]])}]
    v = [{"name": ["audio"], "ons": np.array([[2.0], [6.0], [9.0]]), "dur": np.array([[1.0]])}]
    con = [{"name": "a - v!", "c": np.array([[1.0], [-1.0], [0.0]]), "STAT": "T"}, {"name": "any", "c": np.eye(3), "STAT": "F"}, {"name": "two", "c": np.array([[0.0], [2.0], [0.0]]), "STAT": "T"}]
    return {"SPM": {"Sess": [{"U": u}, {"U": v}], "xBF": {"UNITS": units}, "xY": {"RT": 2.5}, "xX": {"name": ["Sn(1) audio", "Sn(1) video", "constant"]}, "xCon": con}}


@pytest.mark.parametrize(("order", "packed"), [("<", False), (">", False), ("<", True)])
def test_nested_content_is_read_back(order, packed):
    rows = matfiles.decode_mat(mat({"x": np.array([[1.0, 2.0], [3.0, 4.0]]), "s": {"t": "héllo", "c": ["ab", 7.0], "e": np.zeros((0, 0))}, "many": [{"v": 1.0}, {"v": 2.0}]}, order, packed))
    got = {r[0]: r[1:] for r in rows}
    assert got["x"] == ([2, 2], [1.0, 3.0, 2.0, 4.0], None) and got["s.t"][2] == "héllo"
    assert got["s.c{1}"][2] == "ab" and got["s.c{2}"][1] == [7.0] and got["s.e"][1] == [] and got["many(2).v"][1] == [2.0]
    with pytest.raises(ValueError):
        matfiles.decode_mat(b"x" * 200)


def test_designs(spark, tmp_path):
    rows = [("secs.mat", mat(design("secs"))), ("scans.mat", mat(design("scans"), packed=True))]
    files.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path))
    table = matfiles.read_mat(spark, str(tmp_path))
    events = {(r["path"].split("/")[-1], r["session"], r["condition"], r["onset"], r["duration"]) for r in matfiles.spm_events(table).collect()}
    own = {(1, "audio", 1.0, 0.0), (1, "audio", 5.0, 2.0), (1, "video", 3.0, 4.0), (2, "audio", 2.0, 1.0), (2, "audio", 6.0, 1.0), (2, "audio", 9.0, 1.0)}
    assert events == {("secs.mat", *e) for e in own} | {("scans.mat", s, c, 2.5 * o, 2.5 * d) for s, c, o, d in own}
    assert {r["tr"] for r in matfiles.spm_repetition_time(table).collect()} == {2.5}
    one = table.filter("path LIKE '%secs.mat'")
    assert {(r["column"], r["name"]) for r in matfiles.spm_regressors(one).collect()} == {(1, "Sn(1) audio"), (2, "Sn(1) video"), (3, "constant")}
    assert {(r["contrast"], r["expression"]) for r in matfiles.spm_contrasts(one).collect()} == {("a-v", "+audio -video"), ("two", "+2*video")}
