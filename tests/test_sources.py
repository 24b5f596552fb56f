import json
import zipfile

from pyspark.sql import functions as F

from veilwork.sources import files, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def write_all(d):
    (d / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (d / "b.json").write_text(json.dumps({"director": "Ann Lee", "n": 3, "x.y": ["p", {"lei": "q"}]}))
    (d / "c.tsv").write_text("Client Name\tNotes\nAcme Ltd\t\n")
    (d / "bad.json").write_text("{")
    (d / "scan.pdf").write_bytes(b"%PDF-1.4")
    (d / "blank.csv").write_text("\n")
    (d / "empty.csv").write_text("")
    with zipfile.ZipFile(d / "e.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X} {R}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {X}><si><t>Director</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {X}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row><c r="A2" t="inlineStr"><is><t>Ann Lee</t></is></c><c r="AB2"><v>1.50</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(d / "f.docx", "w") as z:
        cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Hello')}{p('')}<w:tbl><w:tr>{cell('Director:')}{cell('Ann Lee')}</w:tr></w:tbl></w:body></w:document>")


def test_files(spark, tmp_path):
    write_all(tmp_path)
    read = files.read_files(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    out = {r["name"]: r for r in files.extract(read, "name").collect()}
    assert out["a.txt"]["text"] == "caf\xe9" and out["a.txt"]["format"] == "txt"
    assert out["b.json"]["text"] == "Director: Ann Lee\np\nLEI: q\n"
    assert [b["block_id"] for b in out["b.json"]["blocks"]] == ["$.director", "$.x.y[0]", "$.x.y[1].lei"]
    assert out["c.tsv"]["text"] == "Client Name, Notes\nAcme Ltd\n"
    assert out["e.xlsx"]["text"] == "Director\n7\nAnn Lee\n1.5\n"
    assert [(b["row"], b["col"], b["header"]) for b in out["e.xlsx"]["blocks"]] == [(1, 1, None), (1, 28, None), (2, 1, "Director"), (2, 28, "7")]
    assert out["f.docx"]["text"] == "Hello\n\nDirector:\nAnn Lee\n"
    for name in ("bad.json", "scan.pdf", "blank.csv"):
        assert out[name]["text"] is None and out[name]["error"]
    assert "empty.csv" not in out  # Spark reads no rows from files of no bytes
    for r in out.values():
        for b in r["blocks"] or []:
            assert r["text"][b["start"]:b["end"]] == b["text"]
    found = files.table_detections(files.blocks(files.extract(read, "name"), "name"), "name").collect()
    assert {(r["name"], r["text"], r["entity_type"], r["detector"]) for r in found} == {
        ("c.tsv", "Acme Ltd", "ORGANISATION", "table.csv_header"), ("e.xlsx", "Ann Lee", "PERSON", "table.xlsx_header"), ("f.docx", "Ann Lee", "PERSON", "table.docx_label_row")}


def test_rewrite(spark, tmp_path):
    write_all(tmp_path)
    read = files.read_files(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    edits = spark.createDataFrame([("b.json", "$.x.y[1].lei", 0, 1, "Z"), ("b.json", "$.director", 0, 3, "Bea"), ("b.json", "$.director", 2, 5, "no"), ("c.tsv", "csv:0:0", 0, 4, "Org"), ("a.txt", "txt:0", 0, 1, "K")],
                                  "name string, block_id string, local_start int, local_end int, replacement string")
    out = {r["name"]: r for r in sinks.rewrite(read, edits, "name").collect()}
    # of two edits that overlap, the later start wins
    assert json.loads(out["b.json"]["content"]) == {"director": "Annoee", "n": 3, "x.y": ["p", {"lei": "Z"}]} and out["b.json"]["n_applied"] == 2
    assert out["c.tsv"]["content"] == "Client Name\tNotes\nOrg Ltd\t\n"
    assert out["a.txt"]["content"] == "Kaf\xe9" and out["bad.json"]["error"] and out["f.docx"]["error"]
