import pytest

from tessera.operators import java_source, unresolved
from tessera.operators.java_source import Source

SERVICE = '''package app.core;

import app.data.Repo;
import lib.ext.Client;

/* a comment with { and ( */
@Service("x")
public class Service<T extends Comparable<T>> extends Base implements Port, Other<String> {
    private static final String OPEN = "{ ( \\" }"; // }
    @Autowired private Repo repo;
    private Map<String, List<Integer>> index = new HashMap<>(), other;
    int[] counts = {1, 2, 3}, sizes;
    private char brace = '{';

    public Service(Repo repo, Client client) {
        this.repo = repo;
        setUp();
    }

    @Override
    @GetMapping(value = "/a", params = {"x"})
    public <R> Map<String, List<R>> find(final String key, Map<String, List<Integer>> more, int... rest) throws Bad, Worse {
        Item local = repo.open(key).first().child(1, more.get(key));
        index = more;
        counts[0]++;
        sizes += 1;
        int index2 = index.size();
        if (index2 < LIMIT && index2 > 0) { helper(a -> a.name(), (x, y) -> {
            return x.join(y);
        }); }
        Client.call(this.repo.open(1), "a,b)", new int[] {1, 2});
        return new Builder(1, 2).with(key).build();
    }

    abstract void nothing();

    private void helper(Function f, BiFunction<A, B> g) { String repo = OPEN; use(repo); super.run(); Runnable r = new Runnable() { public void run() { setUp(); } }; }

    void setUp() { text = """
        { not ( code " }
        """; }

    interface Inner { String name(); enum Kind { A(1), B(2) { void x() {} }; int code; Kind(int code) { this.code = code; } } }
    record Point(int x, int y) { int sum() { return x + y; } }
}
'''


@pytest.fixture(scope="module")
def source(spark):
    rows = [("Service.java", SERVICE), ("Empty.java", ""), ("Null.java", None), ("Broken.java", "class Broken { void a( { ] } int x;"), ("Top.java", "class Top { Top next; int n; Top go(int k) { return this.next.go(k).go(2); } }")]
    return Source(spark.createDataFrame(rows, "path string, text string"))


def test_types_have_the_names_of_those_around_them(source):
    got = {(r["fqn"], r["owner"], r["line"], r["end_line"]) for r in source.types.collect() if r["path"] == "Service.java"}
    assert got == {
        ("app.core.Service", None, 8, 45), ("app.core.Service.Inner", "app.core.Service", 43, 43),
        ("app.core.Service.Inner.Kind", "app.core.Service.Inner", 43, 43), ("app.core.Service.Point", "app.core.Service", 44, 44),
    }


def test_methods_and_constructors(source):
    got = {r["method_id"]: r for r in source.methods().collect() if r["path"] == "Service.java"}
    base = "app.core.Service"
    assert set(got) == {
        f"{base}#Service(Repo,Client)", f"{base}#find(String,Map<String,List<Integer>>,int...)", f"{base}#nothing()", f"{base}#helper(Function,BiFunction<A,B>)",
        f"{base}#setUp()", f"{base}.Inner#name()", f"{base}.Inner.Kind#Kind(int)", f"{base}.Point#sum()",
    }
    find = got[f"{base}#find(String,Map<String,List<Integer>>,int...)"]
    assert (find["arity"], find["returns"], find["kind"], find["line"], find["end_line"]) == (3, "Map", "method", 20, 33)
    assert got[f"{base}#Service(Repo,Client)"]["kind"] == "constructor" and got[f"{base}#Service(Repo,Client)"]["returns"] is None
    assert got[f"{base}#nothing()"]["body"] is None and got[f"{base}#nothing()"]["returns"] is None
    assert got[f"{base}.Inner#name()"]["returns"] == "String"


def test_fields(source):
    got = {(r["owner"].split(".")[-1], r["name"], r["type"], r["line"]) for r in source.fields().collect() if r["path"] == "Service.java"}
    assert got == {
        ("Service", "OPEN", "String", 9), ("Service", "repo", "Repo", 10), ("Service", "index", "Map", 11), ("Service", "other", "Map", 11),
        ("Service", "counts", "int[]", 12), ("Service", "sizes", "int[]", 12), ("Service", "brace", "char", 13), ("Kind", "code", "int", 43),
    }


def test_calls_with_receivers_and_chains(source):
    rows = [r for r in source.calls().collect() if r["path"] == "Service.java"]
    got = {(r["method_id"].split("#")[1].split("(")[0], r["receiver"], ">".join(f"{s['name']}/{s['arity']}" for s in r["chain"]), r["name"], r["arity"]) for r in rows}
    assert got == {
        ("Service", None, "", "setUp", 0), ("find", "repo", "", "open", 1), ("find", "repo", "open/1", "first", 0), ("find", "repo", "open/1>first/0", "child", 2),
        ("find", "more", "", "get", 1), ("find", "index", "", "size", 0), ("find", None, "", "helper", 2), ("find", "a", "", "name", 0), ("find", "x", "", "join", 1),
        ("find", "Client", "", "call", 3), ("find", "this.repo", "", "open", 1), ("find", "Builder", "", "with", 1), ("find", "Builder", "with/1", "build", 0),
        ("helper", None, "", "use", 1), ("helper", "super", "", "run", 0), ("helper", None, "", "setUp", 0),
    }


def test_names_feed_field_accesses(source):
    names, local_names = source.used_names()
    got = {(r["method_id"].split("#")[1].split("(")[0], r["field_id"].split("#")[1], r["access"]) for r in unresolved.field_accesses(names, source.fields().select("field_id", "owner", "name"), local_names).collect()}
    assert got == {
        ("Service", "repo", "writes"), ("find", "repo", "reads"), ("find", "index", "writes"), ("find", "index", "reads"), ("find", "counts", "reads"), ("find", "sizes", "reads"),
        ("find", "sizes", "writes"), ("helper", "OPEN", "reads"), ("Kind", "code", "writes"), ("go", "next", "reads"),
    }


def test_lambdas(source):
    got = {(tuple(r["parameters"]), r["argument_of"], r["line"], r["end_line"]) for r in source.lambdas().collect()}
    assert got == {(("a",), "helper", 28, 28), (("x", "y"), "helper", 28, 30)}


def test_unbalanced_text_gives_no_callables(source):
    assert [r["name"] for r in source.methods().collect() if r["path"] == "Broken.java"] == []
    assert {r["fqn"] for r in source.types.collect() if r["path"] in ("Empty.java", "Null.java")} == set()


def test_a_chain_of_any_length_is_followed(spark):
    n = 9
    steps = "".join(f".s{i}()" for i in range(n))
    files = [("A.java", f"package p; class A {{ B b; void run() {{ b{steps}.end(); }} }}"), ("B.java", "package p; class B { " + "".join(f"B s{i}() {{ return this; }} " for i in range(n)) + "void end() { } }")]
    source = Source(spark.createDataFrame(files, "path string, text string"))
    methods = source.methods().select("method_id", "owner", "name", "arity", "returns")
    calls = source.calls()
    longest = calls.filter("name = 'end'").first()
    assert longest["receiver"] == "b" and [s["name"] for s in longest["chain"]] == [f"s{i}" for i in range(n)]
    some = calls.filter("name in ('end', 's5', 's0')")
    out = {r["target"] for r in unresolved.resolve_calls(some, methods, source.fields().select("owner", "name", "type"), source.types.select("fqn", "simple", "package"), source.imports()).collect()}
    assert out == {"p.B#end()", "p.B#s5()", "p.B#s0()"}


def test_matched_brackets_of_a_kind(spark):
    frame = spark.createDataFrame([("a", j, t) for j, t in enumerate("([]{)x}")] + [("b", j, t) for j, t in enumerate(")(a[b](c))")], "path string, j int, token string")
    got = {(r["path"], r["j"]): (r["partner"], r["block"]) for r in java_source.matched(frame).collect()}
    assert got["a", 0] == (None, None) and got["a", 1][0] == 2 and got["a", 3][0] is None
    assert got["b", 0][0] is None
    assert (got["b", 3][0], got["b", 6][0]) == (5, 8)


def test_texts_are_dealt_once_and_tokens_sorted_twice(spark):
    """By place and by depth; what is at a depth, partners too, is read off one order."""
    files = spark.createDataFrame([("a", "f(x[1]) { y }")], "path string, text string")
    plan = java_source.matched(java_source.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate explode") < plan.index("Generate posexplode") < plan.index("Exchange")
    assert plan.count("Sort [") == 3 and "[path#" in plan
