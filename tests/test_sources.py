import gzip
import json

import pytest
from pyspark.sql import functions as F

from cladeflow.sources import formats as fm
from cladeflow.sources import tables as tb


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("; a note\nmore\n>one first record\nacgt\nAC GT\n>two\n>three\r\nNN-\r\n")
    (tmp_path / "b.fasta").write_text(">four\nA\n")
    with gzip.open(tmp_path / "c.fasta.gz", "wt") as f:
        f.write(">five\nACGT\n")
    got = {r["name"]: (r["defline"], r["seq"]) for r in tb.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"one": ("one first record", "ACGTACGT"), "two": ("two", ""), "three": ("three", "NN-"), "four": ("four", "A"), "five": ("five", "ACGT")}


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT", "clean"), ("b", None, "held"), ("c", "GG", "clean")], "name string, seq string, status string")
    tb.write_fasta(df, str(tmp_path / "out"), "name", "seq", "status")
    got = {(r["name"], r["seq"]) for r in tb.read_fasta(spark, str(tmp_path / "out" / "status=clean")).collect()}
    assert got == {("a", "ACGT"), ("c", "GG")}


@pytest.mark.parametrize("text", ["3 8\na ACGTACGT\nb ACGT\nACGA\nc TTTTTTTT\n", "3 8\na ACGT\nb ACGT\nc TTTT\n\nACGT\nACGA\nTTTT\n"])
def test_phylip(text):
    assert fm.phylip(text) == [("a", "ACGTACGT"), ("b", "ACGTACGA"), ("c", "TTTTTTTT")]


def test_nexus():
    body = "#NEXUS\nbegin data;\nformat datatype=dna interleave;\nmatrix\n'a b' AC\nc GG\n\n'a b' GT\nc TT\n;\nend;\nbegin trees;\ntree t = [&R] ((a:1,b:2):1,c:3);\nend;"
    assert fm.nexus(body) == [("a b", "ACGT"), ("c", "GGTT")]
    assert fm.embedded_newick(body) == "((a:1,b:2):1,c:3);"
    plain = "#NEXUS\nbegin taxa;\ntaxlabels x y;\nend;\nbegin data;\nformat nolabels;\nmatrix\nAC\nGT\n;\nend;"
    assert fm.nexus(plain) == [("x", "AC"), ("y", "GT")]
    assert fm.nexus("nothing") == []


def test_beast_auspice_and_site_tests():
    one = '<beast><taxa><taxon id="t"><date value="2001.5"/></taxon></taxa><alignment><sequence><taxon idref="t"/>AC GT</sequence></alignment></beast>'
    two = '<beast><data><sequence id="seq_t" value="acgt"/></data><trait traitname="date" value="t=2001.5,u=x"/></beast>'
    assert fm.beast_xml(one) == fm.beast_xml(two) == [("t", "ACGT", 2001.5)]
    tree = {"tree": {"name": "r", "children": [{"name": "a", "node_attrs": {"num_date": {"value": 2020.5}, "country": {"value": "X"}}}, {"name": "b", "node_attrs": {}}]}}
    assert fm.auspice(json.dumps(tree)) == fm.auspice(json.dumps(tree["tree"])) == [("a", 2020.5, None, "X"), ("b", None, None, None)]
    assert fm.auspice(json.dumps({"name": "x|y|2021-01-01"})) == [("x|y|2021-01-01", 2021.0, None, None)]
    dated = '<beast><data><sequence taxon="u" value="AUGu"/><sequence taxon="v" value="AC"/></data><data><sequence taxon="w" value="A"/></data><trait traitname="date-forward">u=2020-07-01;v=31/12/2000\n w = 07/1999</trait><init newick="(u[&amp;rate=1]:1,v:2)"/></beast>'
    assert [(n, s, round(t, 4)) for n, s, t in fm.beast_xml(dated)] == [("u", "ATGT", 2020.4973), ("v", "AC", 2000.9945), ("w", None, 1999.5342)]
    assert fm.beast_tree(dated) == "(u:1,v:2);" and fm.beast_tree(one) == ""
    assert [fm.written_year(x) for x in ("1500", "x", "", None, "2001", "2001-XX", "13/13/2000")] == [None, None, None, None, 2001.0, 2001 + 165 / 365, None]
    doc = {"MLE": {"headers": [["x", ""], ["LRT", "d"], ["p-value", "d"]], "content": {"0": [[0, -1, 0.5], [0, 4, 0.1]], "1": [[0, 2, 0.2]]}}, "data partitions": {"0": {"coverage": [[4, 5]]}, "1": {"coverage": [[0]]}}}
    assert fm.site_tests(json.dumps(doc)) == [(5, 0.0, 0.5), (6, 4.0, 0.1), (1, 2.0, 0.2)]


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "a.phy").write_text("1 2\na AC\n")
    (tmp_path / "b.phy").write_text("2 2\nb AC\nc GT\n")
    got = fm.read_files(spark, str(tmp_path), fm.phylip, "name string, seq string").collect()
    assert sorted((r["ord"], r["name"], r["seq"]) for r in got) == [(0, "a", "AC"), (0, "b", "AC"), (1, "c", "GT")]


def test_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Strain\tcollection_date\tCountry\tlatitude\n a\t2001\tX\t1.5\nb\t\tY\tbad\n")
    got = tb.read_metadata(spark, str(tmp_path / "m.tsv")).collect()
    assert [(r["date"], r["location"], r["lat"], r["lon"]) for r in got] == [("2001", "X", 1.5, None), (None, "Y", None, None)]
    assert tb.resolve_columns(["ID", "x"]) == {"id": "ID"}


def test_distances(spark, tmp_path):
    (tmp_path / "d.csv").write_text("ID1,ID2,Distance\nb,a,0.1\na,z,0.2\na,c,nan\na,b,oops\n")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    pairs, unknown = tb.read_distances(spark, str(tmp_path / "d.csv"), ids, "k")
    assert sorted((r["i"], r["j"], r["distance"] or -1) for r in pairs.collect()) == [("a", "b", -1), ("a", "b", 0.1), ("a", "c", -1)]
    assert [r["k"] for r in unknown.collect()] == ["z"]


def test_mutations_cigars_and_text_sinks(spark):
    df = spark.createDataFrame([("R175H",), ("p.r1*",), ("junk",), (None,)], "m string")
    assert [tuple(r["x"]) if r["x"] else None for r in df.select(tb.mutation(F.col("m")).alias("x")).collect()] == [("R", 175, "H"), ("R", 1, "*"), None, None]
    p = spark.createDataFrame([("q", "ACGTTGCA", "2=1I2X1D3=", 1)], "q string, s string, c string, at int")
    assert tb.projected(p, "q", "s", "c", "at", 10).first()["seq"] == "-ACTT-GCA-"
    g = spark.createDataFrame([(1.0, 2.0, "x"), (None, 2.0, "y")], "lat double, lon double, n string")
    got = [json.loads(r["value"]) for r in tb.geojson_points(g, "lat", "lon", "n").collect()]
    assert got[0]["geometry"]["coordinates"] == [2.0, 1.0]
    assert got[1]["geometry"] is None
    e = spark.createDataFrame([("a&b", "c", 1.5)], "i string, j string, w double")
    assert '<node id="a&amp;b"/>' in [r["value"] for r in tb.graphml(e, "w").collect()]


def test_clock_xml_reads_back():
    doc = fm.clock_xml([("a&b", "ACGT", 2001.5), ("c", "AC-T", 2002.25)], "(a:1,c:2);", 1e-3)
    assert fm.beast_xml(doc) == [("a&b", "ACGT", 2001.5), ("c", "AC-T", 2002.25)]
