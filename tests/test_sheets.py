"""OpenDocument sheets, read as they come, and registers below other lines."""

import zipfile

import pytest
from pyspark.sql import functions as F

from waymark.sources import files

HEAD = '<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet>'


def cell(text, times=1):
    body = "".join(f"<text:p>{line}</text:p>" for line in text.split("\n")) if text else ""
    return f'<table:table-cell table:number-columns-repeated="{times}">{body}</table:table-cell>'


def ods(path, sheets):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("content.xml", "w", force_zip64=True) as out:
        out.write(HEAD.encode())
        for name, rows in sheets.items():
            out.write(f'<table:table table:name="{name}"><table:table-column/>'.encode())
            for row in rows:
                out.write(f"<table:table-row>{row}</table:table-row>".encode())
            out.write(b"</table:table>")
        out.write(b"</office:spreadsheet></office:body></office:document-content>")


def test_repeated_cells_and_headers(spark, tmp_path):
    rows = [cell("A survey"), "", cell(" Code ") + cell("Name") + cell("") + cell("Name") + cell("", 16_000), cell("F-1") + cell("", 2) + cell("<text:span>RAF</text:span> depot\nold") + cell("", 9), cell("x", 200) + cell("end"), cell("", 16_384), cell("F-2") + cell("<text:s/>")]
    ods(tmp_path / "a.ods", {"Other": [cell("no")], "Data": rows})
    ods(tmp_path / "b.ods", {"Data": [cell("Code"), cell("G-1")]})
    found = files.read_sheet(spark, str(tmp_path / "*.ods"), "Data").cache()
    a = {r.row: r.cells for r in found.where(F.endswith("file", F.lit("a.ods"))).collect()}
    assert a == {0: ["A survey"], 1: [], 2: [" Code ", "Name", "", "Name"], 3: ["F-1", "", "", "RAF depot\nold"], 4: ["x"] * 200 + ["end"], 5: [], 6: ["F-2"]}
    told = sorted((r.file[-5:], r.row, r.fields) for r in files.under_header(found, "Code").collect())
    assert told == [("a.ods", 3, {"Code": "F-1", "Name": "RAF depot\nold"}), ("a.ods", 4, {"Code": "x", "Name": "x"}), ("a.ods", 6, {"Code": "F-2"}), ("b.ods", 1, {"Code": "G-1"})]
    assert files.read_sheet(spark, str(tmp_path / "b.ods"), "None").count() == 0


def test_a_large_sheet_takes_little_room(tmp_path):
    import sys

    row = "".join(cell(f"value {i} of a row") for i in range(40))
    ods(tmp_path / "big.ods", {"Data": (row for _ in range(12_000))})  # some 50 MB of XML
    with zipfile.ZipFile(tmp_path / "big.ods") as z:
        assert z.getinfo("content.xml").file_size > 45e6
    packed = (tmp_path / "big.ods").read_bytes()
    held = {}
    for n, cells in enumerate(files._sheet_rows(packed, "Data")):
        assert len(cells) == 40
        if n in (1_000, 11_000):
            held[n] = sys.getallocatedblocks()
    assert n == 11_999 and held[11_000] - held[1_000] < 20_000, held  # a row has hundreds of blocks; none of those that have been told are kept


def test_a_register_wider_than_it_seems(spark, tmp_path):
    names = ",".join(f"c{i}" for i in range(150))
    (tmp_path / "r.csv").write_text(f"Some register\n,,\n{names}\n" + ",".join(str(i) for i in range(150)) + "\n" + "," * 149 + "\n")
    out = files.read_register(spark, str(tmp_path / "r.csv"), "c0").where("c1 is not null").collect()
    assert len(out) == 1 and out[0].c149 == "149"
    with pytest.raises(ValueError, match="no line"):
        files.read_register(spark, str(tmp_path / "r.csv"), "c999")
