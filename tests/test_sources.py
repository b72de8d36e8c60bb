"""Four-file cases, folders, manifests and table sinks."""

from pyspark.sql import types as T

from ledgerscope.operators import case_files, records
from ledgerscope.sources import readers, tables

FILES = {
    "transactions.csv": "txid,timestamp,fee,size\n TX1 ,2024-01-01T00:10:00Z,0.1,250\ntx0,1704067200,,x\n",
    "inputs.csv": "txid,prev_txid,prev_vout,address,amount\ntx1,TX0,0,A,1.5\n",
    "outputs.csv": "txid,output_index,address,amount\ntx0,0,A,1.5\ntx1,0,B,1.4\n",
    "network.csv": "txid,timestamp,src_ip,src_port,dst_ip,dst_port,asn,geo_country\n"
    "tx1,2024-01-01T00:10:01Z,10.0.0.1:8333,50000,bad,8333,as1,us\n",
}


def write(folder, names):
    for name in names:
        (folder / name).write_text(FILES[name])
    return str(folder)


def test_four_file_case(spark, tmp_path):
    folder = write(tmp_path, FILES)
    assert readers.is_four_file_case(spark, folder)
    case = readers.read_four_file_case(spark, folder)
    rows = {r["txid"]: r for r in case.transactions.collect()}
    assert rows["tx0"]["record_id"] == "tx-rec-000000" and rows["tx1"]["record_id"] == "tx-rec-000001"
    assert (rows["tx0"]["fee"], rows["tx0"]["size"], rows["tx1"]["timestamp_iso"]) == (0.0, 0, "2024-01-01T00:10:00Z")
    assert case.inputs.first()["prev_txid"] == "tx0"
    net = case.network.first()
    assert (net["src_ip"], net["dst_ip"], net["asn"], net["geo_country"]) == ("10.0.0.1", "0.0.0.0", "AS1", "US")


def test_missing_file_and_bad_values(spark, tmp_path):
    part = tmp_path / "part"
    part.mkdir()
    folder = write(part, ["transactions.csv", "inputs.csv", "outputs.csv"])
    codes = [r["code"] for r in case_files.case_findings(readers.four_files(spark, folder), spark).collect()]
    assert codes == ["E001_INPUT_FILE_MISSING"]
    whole = tmp_path / "whole"
    whole.mkdir()
    found = case_files.case_findings(readers.four_files(spark, write(whole, FILES)), spark).collect()
    assert ("E002_SCHEMA_INVALID", "size") in {(r["code"], r["column"]) for r in found}
    assert ("E004_TRANSACTION_REFERENCE_MISSING", "inputs.csv") in {(r["code"], r["file"]) for r in found}


def test_folder_of_mixed_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("record_id,timestamp,txid,senders,input_value,recipients,output_value,fee\nr1,2024-01-01,t1,A|B,1|2,C,2.9,0.1\n")
    (tmp_path / "b.json").write_text('[{"record_id": "n1", "ts": "2024-01-01T00:00:05Z", "tx_hash": "t1", "client_ip": "10.0.0.1", "server_ip": "10.0.0.2"}]')
    (tmp_path / "notes.md").write_text("ignored")
    case = records.to_case(records.normalize(readers.read_folder(spark, str(tmp_path))))
    assert [r["txid"] for r in case.transactions.collect()] == ["t1"]
    assert {(r["address"], r["amount"]) for r in case.inputs.collect()} == {("A", 1.0), ("B", 2.0)}
    assert [r["src_ip"] for r in case.network.collect()] == ["10.0.0.1"]


def test_tables_and_manifest(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    path = str(tmp_path / "t")
    assert tables.read_table(spark, path, schema).count() == 0
    tables.write_table(spark.createDataFrame([], schema), path)
    assert tables.read_table(spark, path).columns == ["k", "v"]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "x.txt").write_text("one")
    before = spark.createDataFrame(tables.fingerprints(spark, str(docs)).collect())
    assert tables.altered(before, tables.fingerprints(spark, str(docs))).count() == 0
    (docs / "x.txt").write_text("two!")
    assert [r["relative_path"] for r in tables.altered(before, tables.fingerprints(spark, str(docs))).collect()] == ["x.txt"]


def columns(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_json_files_are_judged_one_by_one(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"cut": \n{"txid": "t1", "fee": 0.5}\n["no object"]\n{"txid": "t2", "in": ["A", "B"]}\n')
    (tmp_path / "array.json").write_text('[1,\n {"txid": "t3"},\n "x",\n {"TXID": "t4", "more": {"k": 1}}\n]')
    (tmp_path / "wrapped.json").write_text('{\n "data": [\n  {\n   "txid": "t5"\n  }\n ]\n}')
    (tmp_path / "single.json").write_text('﻿{\n "txid": "t6"\n}')
    (tmp_path / "line.json").write_text('{"records": [{"txid": "t7"}, {"txid": "t8"}]}')
    (tmp_path / "broken.json").write_text('[{"txid": "lost"}\n')
    got = readers.read_json(spark, str(tmp_path))
    name = next(c for c in got.columns if c.lower() == "txid")
    assert [t for (t,) in columns(got, name)] == [f"t{i}" for i in range(1, 9)]
    assert columns(got.where("`in` is not null"), "in") == [('["A","B"]',)]
    assert len({r["record_id"] for r in got.collect()}) == 8


def test_mostly_broken_lines_keep_the_good_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"txid": "t1"}\n{"txid": "t2"}\nbad\nworse\n{"cut": \n')
    (tmp_path / "b.json").write_text('{"txid": "t3"} ]\n{"txid": "t4"}\n["no object"]\n{"txid": "lost"}}\n')
    (tmp_path / "c.json").write_text('{"txid": "lost"}{"txid": "lost"}\n{"txid": "lost"} , {"txid": "lost"}\n{"txid": "t5"}\n')
    (tmp_path / "d.json").write_text('[\n{"txid": "t6"},\n{"txid": "t7"}\n]\n')
    assert columns(readers.read_json(spark, str(tmp_path)), "txid") == [(f"t{i}",) for i in (1, 2, 4, 5, 6, 7)]


def test_xml_takes_every_child_of_the_root(spark, tmp_path):
    path = tmp_path / "mixed.xml"
    path.write_text(
        '<?xml version="1.0"?>\n<!-- a <note> --><dataset>\n<transaction><txid>t1</txid><input_addresses><item>A</item><item>B</item>'
        "</input_addresses></transaction>\n<observation>\n<txid>t1</txid><src_ip>1.2.3.4</src_ip></observation><flag/><transaction>"
        "<txid>t2</txid></transaction></dataset>"
    )
    assert readers.record_tags(spark, str(path)) == ["flag", "observation", "transaction"]
    got = readers.read_records(spark, str(path)).where("txid is not null")
    assert sorted(r["txid"] for r in got.collect()) == ["t1", "t1", "t2"]
    assert [r["input_addresses"] for r in got.where("input_addresses is not null").collect()] == [["A", "B"]]
    single = tmp_path / "one.xml"
    single.write_text("<record><txid>t9</txid></record>")
    assert [r["txid"] for r in readers.read_xml(spark, str(single)).collect()] == ["t9"]


def test_csv_files_have_their_own_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text("txid,fee\nt1,0.5\nt2,\n")
    (tmp_path / "b.csv").write_text("﻿fee;TX_HASH;note\n0.7;t3;x,y\n")
    got = readers.read_csv(spark, str(tmp_path))
    assert columns(got, "txid", "fee") == [("t1", "0.5"), ("t2", ""), ("t3", "0.7")]
    assert columns(got.where("note is not null"), "note") == [("x,y",)]


def test_json_lines_are_taken_apart_once(spark, tmp_path):
    lines = [
        '{"txid": "a", "fee": 1}', '{"txid": "b"},{"txid": "c"}', '{"txid": "d"}],[{"txid": "e"}', '{"txid": "f"}},{"txid": "g"}',
        '{"txid": "h', 'null', '{"records": [{"txid": "i"}, 7, {"txid": "j"}]}', '  {"txid": "k"}  ', '{"txid": "l"}', '{"txid": "m"}',
    ]
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    got = readers.read_json(spark, str(tmp_path))
    assert {r["record_id"]: r["txid"] for r in got.collect()} == {
        f"json-row-{i:06d}": t for i, t in enumerate(["a", "i", "j", "k", "l", "m"], 1)
    }
    # The texts are parsed ahead of the written table, not again for names, numbers and records.
    assert "parse_json" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
