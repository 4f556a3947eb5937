import zipfile

from tessera.operators import code_graph
from tessera.sources import readers

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def make_xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="Rules" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><t>Key</t></si><si><t>Limit</t></si></sst>')
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>status</t></is></c><c r="B2"><v>12.0</v></c></row><row r="3"><c r="AB3" t="b"><v>1</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{S}"><sheetData>{cells}</sheetData></worksheet>')


def test_xlsx_cells_and_records(spark, tmp_path):
    make_xlsx(tmp_path / "rules.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    cells = readers.read_xlsx_cells(spark, str(tmp_path))
    assert {(r["ref"], r["col"], r["value"]) for r in cells.filter("error is null").collect()} == {("A1", 1, "Key"), ("B1", 2, "Limit"), ("A2", 1, "status"), ("B2", 2, "12"), ("AB3", 28, "true")}
    assert cells.filter("error is not null").count() == 1
    records = {(r["name"], r["value"], r["source_ref"]) for r in readers.sheet_records(cells).collect()}
    assert records == {("Key", "status", "rules.xlsx#Rules!A2"), ("Limit", "12", "rules.xlsx#Rules!B2")}


def test_docx_paragraphs(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>rule</w:t></w:r></w:p></w:body></w:document>')
    rows = readers.read_docx_paragraphs(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["style"], r["text"]) for r in rows] == [(0, "Heading1", "Scope"), (2, None, "One rule")]


def test_docx_tables_and_unsafe_archives(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda *texts: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts) + "</w:tc>"
    with zipfile.ZipFile(tmp_path / "t.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr>{cell("Key")}{cell("Rule")}</w:tr><w:tr>{cell("k1")}{cell("one", "two")}</w:tr><w:tr>{cell("")}</w:tr></w:tbl></w:body></w:document>')
    make_xlsx(tmp_path / "rules.xlsx")
    with zipfile.ZipFile(tmp_path / "bad.xlsx", "w") as z:
        z.writestr("../out.xml", "x")
    cells = readers.read_cells(spark, str(tmp_path))
    assert {(r["ref"], r["value"]) for r in cells.filter("ending = '.docx'").collect()} == {("R1C1", "Key"), ("R1C2", "Rule"), ("R2C1", "k1"), ("R2C2", "one\ntwo")}
    (bad,) = cells.filter("error is not null").collect()
    assert bad["path"].endswith("bad.xlsx") and "leaves" in bad["error"]
    signals = {r["file_name"]: (r["first_row"], r["terms"]) for r in readers.sheet_signals(cells.filter("error is null"), most_rows=2, most_columns=2).collect()}
    assert signals == {"t.docx": (["Key", "Rule"], ["Key", "Rule", "k1", "one\ntwo"]), "rules.xlsx": (["Key", "Limit"], ["12", "Key", "Limit", "status"])}


def test_reports_and_properties(spark, tmp_path):
    (tmp_path / "c.info").write_text("TN:\nSF:a.js\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.js\nDA:1,1\nDA:1,3\nend_of_record\n")
    assert {tuple(r) for r in readers.read_lcov(spark, str(tmp_path)).collect()} == {("a.js", 1, 2), ("a.js", 2, 0), ("b.js", 1, 4)}
    (tmp_path / "j.xml").write_text('<!DOCTYPE report PUBLIC "x" "y"><report><package name="p/q"><sourcefile name="A.java"><line nr="3" mi="0" ci="4"/></sourcefile></package></report>')
    (row,) = readers.read_jacoco(spark, str(tmp_path)).collect()
    assert (row["file"], row["line"], row["missed"], row["covered"]) == ("p/q/A.java", 3, 0, 4)
    (tmp_path / "m.properties").write_text("# note\na.b = one \\\n   two\nkey:3\na.b=last\n")
    assert {(r["name"], r["value"], r["line"]) for r in readers.read_properties(spark, str(tmp_path)).collect()} == {("a.b", "last", 5), ("key", "3", 4)}
    (tmp_path / "v.json").write_text('{"meta": {}, "files": {"m.py": {"executed_lines": [1, 2], "missing_lines": [3], "summary": {}}, "n.py": {"executed_lines": []}}}')
    told = readers.read_coverage_json(spark, str(tmp_path))
    assert {tuple(r) for r in told.collect()} == {("m.py", 1, True), ("m.py", 2, True), ("m.py", 3, False)}
    every = readers.coverage_lines(readers.read_lcov(spark, str(tmp_path)), readers.read_jacoco(spark, str(tmp_path)), told)
    assert every.filter("covered").count() == 5 and every.count() == 7
    assert {(r["name"], r["value"]) for r in readers.read_properties(spark, str(tmp_path)).collect()} == {("a.b", "last"), ("key", "3")}


def test_code_graph(spark, tmp_path):
    sources = {
        "src/shop/Cart.java": 'package shop;\nimport shop.item.Item;\nimport java.util.List;\npublic class Cart {\n  @GetMapping("/carts/{id}")\n  public Item first(String id) { return null; }\n}\n',
        "src/shop/item/Item.java": "package shop.item;\npublic class Item {}\n",
        "src/other/Item.java": "package other;\nclass Item {}\n",
        "tests/test_cart.py": "import cart\n\ndef test_it():\n    pass\n",
        "lib/cart.py": "class Basket:\n    def add(self):\n        pass\n",
        "readme.txt": "none",
    }
    for name, text in sources.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = readers.read_source_tree(spark, str(tmp_path))
    assert files.count() == 5
    assert [r["role"] for r in files.filter("path like '%test_cart.py'").collect()] == ["test"]
    symbols = {(r["symbol_type"], r["fqn"]) for r in code_graph.symbols(files).collect()}
    assert {("type", "shop.Cart"), ("type", "shop.item.Item"), ("type", "Basket"), ("callable", "add"), ("callable", "shop.first")} <= symbols
    edges = {(r["target"], r["resolution_status"]) for r in code_graph.import_edges(files).collect()}
    assert edges == {("shop.item.Item", "resolved"), ("java.util.List", "external"), ("cart", "resolved")}
    names = files.filter("path like '%.java'").select("path").selectExpr("path", "'Item' as name")
    got = {r["path"].split("/src/")[1]: r["fqn"] for r in code_graph.type_of(names, files).collect()}
    assert got == {"shop/Cart.java": "shop.item.Item", "shop/item/Item.java": "shop.item.Item", "other/Item.java": "other.Item"}
    (end,) = code_graph.endpoints(files).collect()
    assert (end["method"], end["template"]) == ("GET", "/carts/{*}")
    assert readers.tree_digest(files).first()["digest"] == readers.tree_digest(files.orderBy(files.path.desc())).first()["digest"]


def test_chains_from_calls_to_tables(spark):
    texts = [
        ("a/OrderRepo.java", "java", "public interface OrderRepo extends JpaRepository<Order, Long> {}"),
        ("a/LostRepo.java", "java", "interface LostRepo extends CrudRepository<Missing, Long> {}"),
        ("a/Order.java", "java", '@Entity\n@Table(name = "orders")\npublic class Order {}'),
        ("a/Api.java", "java", '@GetMapping("/orders/{id}") Order one(); @PostMapping("/orders") Order add();'),
        ("ui/a.ts", "typescript", "api.get(`/orders/${id}`); api.post('/orders'); axios.get('/none')"),
    ]
    files = spark.createDataFrame(texts, "path string, language string, text string")
    got = {(r["repository"], r["table_name"], r["resolution_status"]) for r in code_graph.repository_tables(files).collect()}
    assert got == {("OrderRepo", "orders", "resolved"), ("LostRepo", None, "no_target")}
    calls = {(r["method"], r["route"], r["reason"]) for r in code_graph.call_endpoints(files).collect()}
    assert calls == {("GET", "/orders/{*}", "resolved_unique"), ("POST", "/orders", "resolved_unique"), ("GET", "/none", "endpoint_not_found")}
    names = spark.createDataFrame([("findById",), ("saveAll",), ("deleteX",), ("run",)], "m string")
    assert [r[0] for r in names.select(code_graph.database_operation(names.m)).collect()] == ["reads", "writes", "writes", None]


def test_calls_fall_back_to_endpoints_of_any_method(spark):
    java = 'class A { @RequestMapping("/a/{id}") void a() {} @RequestMapping(value = "/b", method = RequestMethod.POST) void b() {} @GetMapping("/a/{x}") void c() {} }'
    script = "axios.get(`/a/${id}`); axios.post('/b'); axios.put(`/a/${id}`); axios.get('/b');"
    files = spark.createDataFrame([("A.java", "java", java), ("s.js", "javascript", script)], "path string, language string, text string")
    methods = {r["endpoint_id"]: r["method"] for r in code_graph.endpoints(files).collect()}
    got = {(r["method"], r["route"], methods.get(r["endpoint_id"]), r["reason"]) for r in code_graph.call_endpoints(files).collect()}
    assert got == {("GET", "/a/{*}", "GET", "resolved_unique"), ("POST", "/b", "POST", "resolved_unique"), ("PUT", "/a/{*}", "ANY", "resolved_unique"), ("GET", "/b", None, "endpoint_not_found")}
