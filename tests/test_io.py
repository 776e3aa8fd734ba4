"""Files go in and come out as they were."""

import numpy as np
import pytest

from fluorite.dataset import EEMDataset
from fluorite.frames import from_numpy, to_numpy
from fluorite.sources import json as J
from fluorite.sources import text as X
from fluorite.sources.text import read_reference_table
from fluorite.sources.workbook import column_number, read_workbook


def write(path, rows, sep="\t"):
    path.write_text("\n".join(sep.join(map(str, r)) for r in rows) + "\n")


def test_matrix_files(spark, tmp_path):
    for n in range(2):
        write(tmp_path / f"2021-02-0{n + 1}_PEM.dat", [["Wavelength", 260, 250], ["note"], [310, 3 + n, 1 + n], [300, 4 + n, 2 + n]])
    stack = X.read_eem_dataset(spark, str(tmp_path), "PEM", index_pos=(1, 10), as_timestamp=True, timestamp_format="%Y-%m-%d")
    assert stack.ex == (250.0, 260.0) and stack.em == (300.0, 310.0)
    assert to_numpy(stack).tolist() == [[[2, 1], [4, 3]], [[3, 2], [5, 4]]]
    assert [r["index"][:10] for r in stack.frame.orderBy("sample").collect()] == ["2021-02-01", "2021-02-02"]
    turned = X.read_eem_dataset(spark, str(tmp_path), "PEM", file_first_row="em")
    assert turned.ex == (300.0, 310.0)
    assert X.file_list(spark, str(tmp_path), "PEM", ["01"]) == ["2021-02-01_PEM.dat"]
    with pytest.raises(ValueError):
        X.read_eem_dataset(spark, str(tmp_path), "none")


def test_commas_and_bad_files(spark, tmp_path):
    write(tmp_path / "a.csv", [["x", 250, 260], [300, 1, 2], [310, 3, 4]], ",")
    assert to_numpy(X.read_eem(spark, str(tmp_path / "a.csv"), delimiter=",")).tolist() == [[[1, 3], [2, 4]]]
    write(tmp_path / "b.dat", [["x", 250, 260], [300, 1], [310, 3, 4]])
    with pytest.raises(Exception, match="differ in width"):
        to_numpy(X.read_eem(spark, str(tmp_path / "b.dat")))
    write(tmp_path / "c.dat", [["x", 250, 260], [300, 1, "bad"]])
    with pytest.raises(Exception, match="not a number"):
        to_numpy(X.read_eem(spark, str(tmp_path / "c.dat")))


def test_alignment(spark, tmp_path):
    write(tmp_path / "a.dat", [["x", 250, 260, 270], [300, 1, 2, 3], [310, 2, 3, 4]])
    write(tmp_path / "b.dat", [["x", 255, 265], [300, 1.5, 2.5], [305, 2, 3], [310, 2.5, 3.5]])
    with pytest.raises(ValueError):
        X.read_eem_dataset(spark, str(tmp_path))
    stack = X.read_eem_dataset(spark, str(tmp_path), wavelength_alignment=True)
    a, b = to_numpy(stack)
    assert np.allclose(a, b) and stack.em == (300.0, 305.0, 310.0)


def test_every_file_of_many_grids_is_aligned(spark, tmp_path):
    for k in range(30):  # a grid for each file, all of the same plane
        ex = [250, 251 + k / 100, 260 + k, 295]
        write(tmp_path / f"f{k:02d}.dat", [["x", *ex], *[[em, *[e + em + k for e in ex]] for em in (300, 310)]])
    stack = X.read_eem_dataset(spark, str(tmp_path), wavelength_alignment=True)
    got = to_numpy(stack)
    assert len(got) == 30 and stack.ex == (250.0, 251.29, 289.0, 295.0)
    want = np.array(stack.ex)[:, None] + np.array(stack.em)[None, :]
    assert all(np.allclose(x, want + k) for k, x in enumerate(got))


def test_absorbance_and_reference(spark, tmp_path):
    write(tmp_path / "S1ABS.dat", [[300, "8.24E-4"], ["text"], [290, "?"], [280, 0.5]])
    table, axis = X.read_abs_dataset(spark, str(tmp_path))
    assert axis == (280.0, 290.0, 300.0)
    a = table.first()["absorbance"]
    assert a[0] == 0.5 and np.isnan(a[1]) and a[2] == 8.24e-4
    (tmp_path / "ref.txt").write_text("doc mg/l\n1.5\n\n2.5\n")
    values, head = X.read_reference_from_text(spark, str(tmp_path / "ref.txt"))
    assert head == "doc" and [r["value"] for r in values.orderBy("position").collect()] == [1.5, 2.5]


def test_json_and_parquet_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).random((3, 2, 4))
    x[1, 1, 2] = np.nan
    ref = spark.createDataFrame([(i, float(i)) for i in range(3)], "sample long, doc double")
    stack = from_numpy(spark, x, [250, 260], [300, 310, 320, 330], index=["a", "b", "c"], cluster=["1", "2", "1"], ref=ref)
    EEMDataset(stack).to_json(str(tmp_path / "d.json"))
    back = J.read_json(spark, str(tmp_path / "d.json"))
    assert np.allclose(to_numpy(back), x, equal_nan=True) and back.ex == stack.ex
    assert [(r["index"], r["cluster"]) for r in back.frame.orderBy("sample").collect()] == [("a", "1"), ("b", "2"), ("c", "1")]
    assert [r["doc"] for r in back.ref.orderBy("sample").collect()] == [0, 1, 2]
    J.write_parquet(stack, str(tmp_path / "p"))
    again = J.read_parquet(spark, str(tmp_path / "p"))
    assert again.em == stack.em and again.frame.count() == 3


def test_reference_table(spark, tmp_path):
    write(tmp_path / "r.csv", [["label", "doc"], ["a", 1], ["z", 2]], ",")
    stack = X.read_reference_table(spark, str(tmp_path / "r.csv"), from_numpy(spark, np.ones((2, 1, 1)), [1], [2], index=["a", "b"]))
    got = {r["sample"]: r["doc"] for r in stack.ref.collect()}
    assert got[0] == 1 and np.isnan(got[1])


def test_reference_workbook(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="z" sheetId="2" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData/></worksheet>",
        "xl/sharedStrings.xml": f"<sst {main}><si><t>name</t></si><si><r><t>do</t></r><r><t>c</t></r></si></sst>",
        "xl/worksheets/sheet2.xml": f'<worksheet {main}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
        '<row r="3"><c r="A3" t="inlineStr"><is><t>s0</t></is></c><c r="C3"><v>1.5</v></c></row><row r="5"><c r="A5" t="str"><v>s1</v></c><c r="C5"/></row></sheetData></worksheet>',
    }
    path = tmp_path / "ref.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    table = read_workbook(spark, str(path))
    assert table.columns == ["name", "doc"] and sorted(map(tuple, table.collect())) == [("s0", "1.5"), ("s1", None)]
    stack = from_numpy(spark, np.ones((3, 1, 1)), [1], [1], index=["s0", "s1", "s2"])
    got = {r["sample"]: r["doc"] for r in read_reference_table(spark, str(path), stack).ref.collect()}
    assert got[0] == 1.5 and np.isnan(got[1]) and np.isnan(got[2])
    assert column_number("AA3") == 26
