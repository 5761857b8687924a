"""Office packages from real zip files written by the test."""

import os
import zipfile

from pyspark.sql import functions as F

from sheaf.operators import office, packages as pk, tables
from sheaf.sources.packages import binary_files, read_members, read_packages


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members:
            z.writestr(name, data)


def build(d):
    make_zip(f"{d}/clean.pptx", [("ppt/slides/slide1.xml", "<p:sld><a:t>Hello</a:t></p:sld>")])
    make_zip(f"{d}/ole.pptx", [("ppt/slides/slide1.xml", '<p:sld><p:oleObj id="1">x</p:oleObj><a:t>A</a:t></p:sld>'),
                               ("ppt/slides/slide2.xml", "<p:sld><a:t>B</a:t></p:sld>")])
    make_zip(f"{d}/chart.pptx", [("ppt/charts/chart1.xml", '<c:chart><c:externalData r:id="r"><c:autoUpdate val="0"/></c:externalData></c:chart>')])
    make_zip(f"{d}/http.pptx", [("ppt/slides/_rels/slide1.xml.rels",
                                 '<Relationships><Relationship Id="r1" Target="https://x" TargetMode="External"/></Relationships>')])
    make_zip(f"{d}/file.pptx", [("ppt/slides/_rels/slide1.xml.rels",
                                 '<Relationships><Relationship Id="r1" Target="file:///x" TargetMode="External"/></Relationships>')])
    make_zip(f"{d}/bin.pptx", [("ppt/slides/slide1.xml", b"\xff\xfe<p:oleObj"), ("ppt/slides/slide2.xml", "<a:t>ok</a:t>")])
    with open(f"{d}/old.ppt", "wb") as f:
        f.write(b"not a zip at all")
    with open(f"{d}/ole.pptx", "rb") as f:
        data = f.read()
    with open(f"{d}/trunc.pptx", "wb") as f:
        f.write(data[: len(data) - 30])
    make_zip(f"{d}/book.xlsx", [("xl/sharedStrings.xml", "<sst><si><t>alpha</t></si><si><t>beta</t></si></sst>"),
                                ("xl/worksheets/sheet1.xml",
                                 '<sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"><v>42</v></c></row>'
                                 '<row r="2"><c r="AA2" t="s"><v>0</v></c></row></sheetData>')])


def test_scan_risk_and_gate(spark, tmpdir_path):
    build(tmpdir_path)
    files = binary_files(spark, tmpdir_path)
    members = read_members(files)
    scans = {os.path.basename(r.path): r for r in pk.link_scan(members, read_packages(files)).collect()}
    assert scans["clean.pptx"].risk_name == "SAFE"
    assert scans["ole.pptx"].risk_name == "HIGH" and scans["ole.pptx"].external_links == ["OLE in ppt/slides/slide1.xml"]
    assert scans["chart.pptx"].risk_name == "MEDIUM" and scans["chart.pptx"].link_types == ["chart"]
    assert scans["http.pptx"].risk_name == "MEDIUM" and scans["file.pptx"].risk_name == "LOW"
    assert scans["bin.pptx"].risk_name == "SAFE"  # undecodable member skipped (F-12)
    assert scans["old.ppt"].risk_name == "SAFE" and scans["old.ppt"].file_size_mb > 0  # not a zip: real size
    assert scans["trunc.pptx"].risk_name == "SAFE"
    gate = {os.path.basename(r.path): r.action for r in pk.gate_decision(pk.link_scan(members, read_packages(files))).collect()}
    assert gate["ole.pptx"] == "sanitize" and gate["file.pptx"] == "proceed" and gate["book.xlsx"] == "proceed"


def test_critical_injection(spark):  # Q8: CRITICAL only by injection
    df = spark.createDataFrame([("a.pptx", 4, False, "CRITICAL"), ("b.pptx", 3, True, "HIGH")],
                               "path string, risk_level int, is_sanitizable boolean, risk_name string")
    got = {r.path: (r.action, r.message) for r in pk.gate_decision(df).collect()}
    assert got["a.pptx"][0] == "reject" and "skipping" in got["a.pptx"][1]
    assert got["b.pptx"][0] == "sanitize"
    no_auto = {r.path: r.action for r in pk.gate_decision(df, auto_sanitize=False).collect()}
    assert no_auto == {"a.pptx": "reject", "b.pptx": "proceed"}


def test_sanitize(spark, tmpdir_path):
    build(tmpdir_path)
    members = read_members(binary_files(spark, tmpdir_path))
    s = {(os.path.basename(r.path), r.member): r for r in pk.sanitize_members(members).collect()}
    assert s[("ole.pptx", "ppt/slides/slide1.xml")].sanitized == "<p:sld><a:t>A</a:t></p:sld>"
    assert s[("chart.pptx", "ppt/charts/chart1.xml")].sanitized == "<c:chart></c:chart>"
    assert s[("http.pptx", "ppt/slides/_rels/slide1.xml.rels")].changed is False  # parity: .rels never visited (Q7)
    s2 = {(os.path.basename(r.path), r.member): r for r in pk.sanitize_members(members, parity=False).collect()}
    assert s2[("http.pptx", "ppt/slides/_rels/slide1.xml.rels")].sanitized == "<Relationships></Relationships>"
    ops = {os.path.basename(r.path): r.operations for r in pk.sanitize_ops(pk.sanitize_members(members)).collect()}
    assert ops["ole.pptx"] == ["Removed OLE from ppt/slides/slide1.xml"]


def test_unclosed_elements_stay(spark):
    df = spark.createDataFrame([("<c:externalData x <c:autoUpdate/>",)], "c string")
    assert df.select(pk.strip_chart_links(F.col("c"))).first()[0] == "<c:externalData x "


def test_slides_and_sheets(spark, tmpdir_path):
    build(tmpdir_path)
    members = read_members(binary_files(spark, tmpdir_path))
    md = {os.path.basename(r.path): r.markdown for r in office.slides_markdown(members).collect()}
    assert md["ole.pptx"] == "## Slide 1\n\nA\n\n## Slide 2\n\nB"
    cells = {(r.cell_ref, r.row_ix, r.col_ix): r.value for r in office.sheet_cells(members).collect()}
    assert cells == {("A1", 0, 0): "beta", ("B1", 0, 1): "42", ("AA2", 1, 26): "alpha"}


def test_shared_strings_entities_and_export(spark):
    strings = ("<sst><si><t>Name</t></si><si/><si><t>A &amp;amp; B</t><rPh sb='0'><t>guide</t></rPh></si>"
               "<si><r><t xml:space='preserve'>C </t></r><r><t>&lt;d&gt;</t></r></si></sst>")
    sheet = ('<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Name</t></is></c></row>'
             '<row r="2"><c r="A2" t="s"><v>2</v></c></row>'
             '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="s"><v>3</v></c></row></sheetData>')
    members = spark.createDataFrame([("b.xlsx", 0, "xl/sharedStrings.xml", strings),
                                     ("b.xlsx", 1, "xl/worksheets/sheet1.xml", sheet)],
                                    "path string, member_ix int, member string, content string")
    cells = office.sheet_tables(office.sheet_cells(members))
    lines = lambda df: [r.line for r in df.orderBy("line_ix").collect()]
    assert lines(tables.to_csv_lines(cells)) == ["Name,Name", "A &amp; B,", ",C <d>"]
    assert lines(tables.to_json_lines(cells)) == ['{"Name":"A &amp; B","Name_2":""}', '{"Name":"","Name_2":"C <d>"}']


def test_self_closed_ole_and_binary_members(spark):
    slide = '<p:sld><p:oleObj id="1"/><a:t>kept</a:t><p:oleObj id="2">x</p:oleObj><a:t>too</a:t></p:sld>'
    members = spark.createDataFrame(
        [("d.pptx", 0, "ppt/slides/slide1.xml", slide, bytearray(slide.encode()), True),
         ("d.pptx", 1, "ppt/media/a.png", None, bytearray(b"\x89PNG\xff"), False)],
        "path string, member_ix int, member string, content string, raw binary, readable boolean")
    out = {r.member: bytes(r.content_out) for r in pk.rewrite_members(members).collect()}
    assert out == {"ppt/slides/slide1.xml": b"<p:sld><a:t>kept</a:t><a:t>too</a:t></p:sld>",
                   "ppt/media/a.png": b"\x89PNG\xff"}


def test_large_package_streams_and_is_rewritten(spark, tmpdir_path):
    """Members come one at a time in parts of bounded size; a package written back from them has the same members."""
    import os
    import random
    import zipfile

    from sheaf.operators import packages as pk
    from sheaf.sources import packages as src
    rng = random.Random(1)
    os.makedirs(f"{tmpdir_path}/in")
    wanted = {}
    with zipfile.ZipFile(f"{tmpdir_path}/in/big.pptx", "w") as z:
        for i in range(12):
            name, data = (f"ppt/slides/slide{i}.xml", b"<p:sld><p:oleObj>x</p:oleObj></p:sld>") if i % 3 == 0 else (f"ppt/media/m{i}.bin", rng.randbytes(700_000))
            z.writestr(name, data)
            wanted[name] = data.replace(b"<p:oleObj>x</p:oleObj>", b"")
        z.writestr("ppt/slides/slide99.xml", b"\xc3")
        wanted["ppt/slides/slide99.xml"] = b"\xc3"
    with zipfile.ZipFile(f"{tmpdir_path}/in/none.pptx", "w"):
        pass
    open(f"{tmpdir_path}/in/text.pptx", "w").write("no zip")
    open(f"{tmpdir_path}/in/cut.pptx", "wb").write(open(f"{tmpdir_path}/in/big.pptx", "rb").read()[:5000])
    directory = src.member_directory(src.package_files(spark, f"{tmpdir_path}/in", "*.pptx"))
    kinds = {r.path.rsplit("/", 1)[-1]: (r.is_zip, r.readable) for r in src.directory_packages(directory).collect()}
    assert kinds == {"big.pptx": (True, True), "none.pptx": (True, True), "text.pptx": (False, True), "cut.pptx": (False, True)}
    parts = src.stream_members(directory, part_bytes=100_000)
    rows = parts.select("member", "part", "readable").collect()
    assert max(r.part for r in rows) == 6 and len(rows) == 5 + 8 * 7
    # what a task holds: a batch closes with the member or part that fills it, and no part is larger than its bound
    sizes = [len(r[5]) for r in src.member_parts(f"{tmpdir_path}/in/big.pptx", [(i, n) for i, n in enumerate(wanted)], 100_000)]
    assert max(sizes) <= 100_000
    batches = list(src._batched((("p", 0, "m", k, None, b"x" * 3_000_000, False) for k in range(20)), src.STREAM_SCHEMA, lambda r: 2 * len(r[5])))
    assert max(b.nbytes for b in batches) < src.BATCH_BYTES + 6_000_000
    for _ in range(2):  # a second run replaces the package
        done = src.write_packages(pk.rewrite_members(parts), f"file://{tmpdir_path}/out").collect()
    assert [(r.target.rsplit("/", 1)[-1], r.members) for r in done] == [("big.pptx", 13)] and os.listdir(f"{tmpdir_path}/out") == ["big.pptx"]
    with zipfile.ZipFile(f"{tmpdir_path}/out/big.pptx") as z:
        assert {n: z.read(n) for n in z.namelist()} == wanted and z.namelist() == list(wanted)
