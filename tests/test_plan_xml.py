"""G5's plan parser: statements that a pattern over the text would lose."""

import pytest

from opslens.operators.index import missing_indexes_from_plans

MISSING = ('<MissingIndexes><MissingIndexGroup Impact="{i}"><MissingIndex Database="[d]" Schema="[s]" Table="[{t}]">'
           '<ColumnGroup Usage="EQUALITY"><Column Name="[c]"/></ColumnGroup></MissingIndex></MissingIndexGroup></MissingIndexes>')


def m(t, i=5):
    return "<QueryPlan>" + MISSING.format(t=t, i=i) + "</QueryPlan>"


CASES = {
    "self_closing_before": ('<StmtSimple StatementText="set x"/><StmtSimple StatementText="q">' + m("t") + "</StmtSimple>", {("q", "[t]", False)}),
    "newline_after_tag": ('<StmtSimple\n  StatementText="q">' + m("t") + "</StmtSimple>", {("q", "[t]", False)}),
    "nested_before_own": ('<StmtSimple StatementText="q"><StmtSimple StatementText="in">' + m("u") + "</StmtSimple>" + m("t") + "</StmtSimple>",
                          {("q", "[t]", False), ("in", "[u]", True)}),
    "nested_without_missing": ('<StmtSimple StatementText="q"><StmtSimple StatementText="in"/>' + m("t") + "</StmtSimple>", {("q", "[t]", False)}),
    "procedure_body": ('<StmtSimple StatementText="exec p"><StoredProc><Statements><StmtSimple StatementText="a">' + m("t") + "</StmtSimple>"
                       '<StmtSimple StatementText="b">' + m("u") + "</StmtSimple></Statements></StoredProc></StmtSimple>",
                       {("a", "[t]", True), ("b", "[u]", True)}),
    "branches": ('<StmtCond><Then><Statements><StmtSimple StatementText="a">' + m("t") + "</StmtSimple></Statements></Then>"
                 '<Else><Statements><StmtSimple StatementText="b">' + m("u") + "</StmtSimple></Statements></Else></StmtCond>",
                 {("a", "[t]", True), ("b", "[u]", True)}),
    "two_groups": ('<StmtSimple StatementText="q"><QueryPlan>' + MISSING.format(t="t", i=9).replace("</MissingIndexes>", "")
                   + MISSING.format(t="u", i=1).replace("<MissingIndexes>", "") + "</QueryPlan></StmtSimple>", {("q", "[t]", False)}),
    "else_if_chain": ("".join(f'<StmtCond><Condition/><Then><Statements><StmtSimple StatementText="b{i}">{m(f"t{i}")}</StmtSimple></Statements></Then>'
                              "<Else><Statements>" for i in range(9)) + "</Statements></Else></StmtCond>" * 9, {(f"b{i}", f"[t{i}]", True) for i in range(9)}),
    "branches_in_a_procedure": ('<StmtSimple StatementText="exec p"><StoredProc><Statements><StmtCond><Then><Statements><StmtCond><Else><Statements>'
                                '<StmtSimple StatementText="a">' + m("t") + "</StmtSimple></Statements></Else></StmtCond></Statements></Then></StmtCond>"
                                "</Statements></StoredProc>" + m("u") + "</StmtSimple>", {("a", "[t]", True), ("exec p", "[u]", False)}),
    "function": ('<StmtSimple StatementText="q">' + m("t") + '<UDF ProcName="f"><Statements><StmtSimple StatementText="in f">' + m("u")
                 + "</StmtSimple></Statements></UDF></StmtSimple>", {("q", "[t]", False), ("in f", "[u]", True)}),
    "function_in_a_condition": ('<StmtCond><Condition>' + m("c") + '<UDF><Statements><StmtSimple StatementText="in f">' + m("u")
                                + "</StmtSimple></Statements></UDF></Condition></StmtCond>", {("in f", "[u]", True)}),
    "cursor": ('<StmtCursor StatementText="c"><CursorPlan><Operation>' + m("c") + '<UDF><Statements><StmtSimple StatementText="in f">' + m("u")
               + "</StmtSimple></Statements></UDF></Operation></CursorPlan></StmtCursor>", {("in f", "[u]", True)}),
    "marks_in_values": ("<!-- <StmtSimple> --><StmtSimple StatementText=\"a > b and c &lt; '/>' &amp; d\" X='\">'>" + m("t") + "</StmtSimple>",
                        {("a > b and c < '/>' & d", "[t]", False)}),
    "none": ('<StmtSimple StatementText="no MissingIndexes here"><QueryPlan/></StmtSimple>', set()),
}


@pytest.mark.parametrize("name", CASES)
def test_each_statement_once(spark, name):
    body, want = CASES[name]
    xml = f"<ShowPlanXML xmlns=\"urn:x\"><BatchSequence><Batch><Statements>{body}</Statements></Batch></BatchSequence></ShowPlanXML>"
    df = spark.createDataFrame([("s", 0, 200, xml)], "server_name string, snapshot_id int, usecounts long, query_plan string")
    rows = missing_indexes_from_plans(df).collect()
    assert len(rows) == len(want) and {(r.sql_text, r.table_name, r.nested) for r in rows} == want
    assert all(r.query_plan == xml for r in rows)


def test_broken_plan_does_not_stop_the_others(spark):
    good = "<ShowPlanXML><BatchSequence><Batch><Statements>" + CASES["self_closing_before"][0] + "</Statements></Batch></BatchSequence></ShowPlanXML>"
    df = spark.createDataFrame([("s", 0, 200, "<MissingIndexes> not xml"), ("s", 0, 200, good)],
                               "server_name string, snapshot_id int, usecounts long, query_plan string")
    assert [r.sql_text for r in missing_indexes_from_plans(df).collect()] == ["q"]
