from tessera.operators import unresolved
from tessera.sources import webflow

CONFIG = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE struts-config PUBLIC "-//X//DTD 1.3//EN" "http://x/dtd">
<!-- <action path="/no"/> -->
<struts-config>
  <form-beans><form-bean name="f" type="a.Form"/></form-beans>
  <global-forwards><forward name="home" path="/search.do"/><forward name="ok" path="shared"/></global-forwards>
  <action-mappings>
    <action path="/search" type="a.Search" name="f" input="/in.jsp"><forward name="ok" path="list"/></action>
    <action path="/go" type="x.ForwardAction" parameter="/go.jsp"/>
    <action path="/plain" forward="/p.jsp"/>
  </action-mappings>
</struts-config>"""
WEB = """<web-app><servlet><servlet-name>s</servlet-name><servlet-class>o.ActionServlet</servlet-class></servlet>
<servlet><servlet-name>t</servlet-name><servlet-class>o.Other</servlet-class></servlet>
<servlet-mapping><servlet-name>s</servlet-name><url-pattern>*.do</url-pattern></servlet-mapping>
<servlet-mapping><servlet-name>s</servlet-name><url-pattern>/do/*</url-pattern></servlet-mapping>
<servlet-mapping><servlet-name>t</servlet-name><url-pattern>*.t</url-pattern></servlet-mapping></web-app>"""
TILES = """<tiles-definitions>
<definition name="base" path="/base.jsp"><put name="title" value="T"/><put name="body" value="B"/></definition>
<definition name="list" extends="base"><put name="body" value="/list.jsp"/></definition>
<definition name="wide" extends="list" path="/wide.jsp"/>
<definition name="a" extends="b"/><definition name="b" extends="c"/><definition name="c" extends="b"/>
<definition name="lost" extends="nowhere"/><definition name="behind" extends="lost"/>
<definition name="twice"/><definition name="twice" extends="base"/>
</tiles-definitions>"""
FILES = [
    ("s.xml", CONFIG), ("w.xml", WEB), ("t.xml", TILES), ("bad.xml", "<struts-config><action-mappings><action path='/x'>"), ("null.xml", None), ("empty.xml", ""),
    ("unsafe.xml", '<!DOCTYPE struts-config [<!ENTITY e "x">]><struts-config/>'), ("other.xml", "<project><action path='/y'/></project>"),
]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_configuration(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    assert rows(webflow.documents(files, "struts-config"), "path", "reason") == [("bad.xml", "malformed_xml"), ("s.xml", None), ("unsafe.xml", "unsafe_xml")]
    assert rows(webflow.actions(files), "action", "type", "form", "input", "target") == [
        ("/go", "x.ForwardAction", None, None, "/go.jsp"), ("/plain", None, None, None, "/p.jsp"), ("/search", "a.Search", "f", "/in.jsp", None),
    ]
    assert rows(webflow.forms(files), "form", "type") == [("f", "a.Form")]
    assert rows(webflow.endpoints(files), "action", "endpoint") == [(a, e) for a in ("/go", "/plain", "/search") for e in (f"/do{a}", f"{a}.do")]
    found = webflow.forwards(files)
    assert rows(found, "action", "name", "target") == [("/search", "ok", "list"), (None, "home", "/search.do"), (None, "ok", "shared")]
    asked = spark.createDataFrame([("/search", "ok"), ("/search", "home"), ("/go", "ok"), ("/go", "none")], "action string, name string")
    targets = unresolved.scoped_targets(asked, found.filter("action IS NOT NULL"), found.filter("action IS NULL"), "action", "name", "target")
    assert rows(targets, "action", "name", "target") == [("/go", "none", None), ("/go", "ok", "shared"), ("/search", "home", "/search.do"), ("/search", "ok", "list")]


def test_definitions_inherit(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    got = {r["name"]: (r["page"], r["puts"], r["depth"], r["reason"]) for r in webflow.inherited_definitions(webflow.definitions(files)).collect()}
    assert got == {
        "base": ("/base.jsp", {"title": "T", "body": "B"}, 0, None), "list": ("/base.jsp", {"title": "T", "body": "/list.jsp"}, 1, None), "wide": ("/wide.jsp", {"title": "T", "body": "/list.jsp"}, 2, None),
        **{n: (None, None, None, "cycle") for n in "abc"}, **{n: (None, None, None, "missing_parent") for n in ("lost", "behind")}, "twice": (None, None, None, "ambiguous_definition"),
    }
    assert webflow.inherited_definitions(webflow.definitions(files.limit(0))).count() == 0


def test_pages(spark):
    text = """<%-- <a href="/no"> --%><html:form action="/search.do" method='post'>
    <a class="x" href='/b.jsp'>b</a><html:link forward="home"/><html:link
      page="/c.jsp"/><a href="${url}">d</a><jsp:include page="/e.jsp" /><tiles:insert definition="list"/><b title="href='/no'">x</b><a name="n">y</a>"""
    got = rows(webflow.page_targets(spark.createDataFrame([("p.jsp", text), ("n.jsp", None)], "path string, text string")), "tag", "kind", "target")
    assert got == [
        ("a", "dynamic", "${url}"), ("a", "route", "/b.jsp"), ("html:form", "action", "/search.do"), ("html:link", "forward", "home"), ("html:link", "route", "/c.jsp"),
        ("jsp:include", "route", "/e.jsp"), ("tiles:insert", "definition", "list"),
    ]
