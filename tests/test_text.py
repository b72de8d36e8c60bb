"""Untidy text to typed values."""

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import text
from ledgerscope.operators import records
from ledgerscope.schema import MATRIX_CONTRACT, network_columns, order_hash, transaction_columns, wallet_columns
from ledgerscope.sources import readers


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_lists(spark):
    got = apply(spark, ['["W1", "W2"]', "W1|W2", "W1; W2", "W1, W2", "W1", "[]", "none", None, '{"a": "x", "b": "y"}', "a|b;c"], text.parse_list)
    assert got == [["W1", "W2"]] * 4 + [["W1"], [], [], [], ["x", "y"], ["a", "b;c"]]


def test_addresses(spark):
    given = ["192.168.1.1", "2001:0DB8:0:0:0:0:0:1", "1:0:0:0:0:0:0:0", "::", "999.1.1.1", "Not-An-IP", " none ", "0:0:1:0:0:0:1:1", "1::2::3"]
    assert apply(spark, given, text.normalize_ip) == [
        "192.168.1.1", "2001:db8::1", "1::", "::", "999.1.1.1", "not-an-ip", None, "0:0:1::1:1", "1::2::3",
    ]
    assert apply(spark, given, text.ip_ok) == [True, True, True, True, False, False, False, True, False]
    assert apply(spark, ["10.0.0.1:8333", "nan", "bad", None], text.clean_ip) == ["10.0.0.1", "0.0.0.0", "0.0.0.0", "0.0.0.0"]


def test_times_and_ports(spark):
    given = ["1704067200", "1704067200000", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2024-01-01 00:00:00", "2024/01/01 00:00:00"]
    seen = apply(spark, given + ["soon", ""], lambda c: F.unix_seconds(text.parse_timestamp(c)))
    assert seen == [1704067200] * 6 + [None, None]
    assert apply(spark, ["8333", "70000", "-1", "x", None], text.parse_port) == [8333, None, None, None, None]


def test_alias_mapping_and_issues(spark):
    raw = spark.createDataFrame(
        [
            ("r1", "2024-01-01T00:00:00Z", "tx1", "A|B", "1.0", "C", "0.9", "0.1", "10.0.0.1", "99999"),
            ("r2", "2024-01-01T00:00:00Z", "tx2", "A", "1.0", "C", "0.5", "0.1", "10.0.0.1", "8333"),
            ("r3", "", "", "A", "-1.0", "C", "x", "-2", "300.0.0.1", "8333"),
        ],
        "record_id string, Time string, TX_HASH string, senders string, input_value string, recipients string, "
        "output_value string, tx_fee string, client_ip string, dest_port string",
    )
    checked = records.validate(records.map_columns(raw))
    got = {}
    for r in records.issue_rows(checked).collect():
        got.setdefault(r["record_id"], set()).add(r["code"])
    assert got["r1"] == {"ARRAY_PARITY_INPUT_MISMATCH", "INVALID_DST_PORT"}
    assert got["r2"] == {"MONETARY_DISCREPANCY"}
    assert got["r3"] == {
        "MISSING_TIMESTAMP", "MISSING_TXID", "NEGATIVE_INPUT_AMOUNT", "INVALID_OUTPUT_AMOUNT", "NEGATIVE_FEE", "INVALID_SRC_IP",
    }
    assert records.counters(checked).first().asDict() == {"total_rows": 3, "accepted_rows": 1, "rejected_rows": 2, "warning_count": 1}


def test_matrix_contract():
    for domain, columns in (("transaction", transaction_columns()), ("wallet", wallet_columns()), ("network", network_columns())):
        assert (len(columns), order_hash(columns)) == MATRIX_CONTRACT[domain]


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_csv_delimiters_and_blank_ids(spark, tmp_path, mark):
    path = tmp_path / "in.csv"
    rows = [["record_id", " Timestamp", "txid", "fee"], ["a", "2024-01-01", "t1", "1"], ["", "2024-01-02", "t2", "2"]]
    path.write_text("﻿" + "\n".join(mark.join(r) for r in rows) + "\n")
    got = readers.read_records(spark, str(path)).orderBy("txid").collect()
    assert [(r["record_id"], r["txid"], r["fee"]) for r in got] == [("a", "t1", "1"), ("csv-row-000002", "t2", "2")]


def test_json_shapes_and_xml(spark, tmp_path):
    one = '{"txid": "t1", "inputs": ["A", "B"], "fee": 1}'
    shapes = {
        "a.json": f"[{one},\n {one}]",
        "b.json": '{"records": [' + one + "]}",
        "c.json": '{\n"data": [' + one + "]}",
        "d.json": '{\n"txid": "t1",\n"inputs": ["A", "B"], "fee": 1}',
        "e.ndjson": one + "\nnot json\n" + one + "\n",
        "f.xml": "<records>\n<tx><txid>t1</txid><inputs><a>A</a><a>B</a></inputs><fee>1</fee></tx>\n</records>",
    }
    for name, content in shapes.items():
        (tmp_path / name).write_text(content)
        got = readers.read_records(spark, str(tmp_path / name)).collect()
        assert len(got) == (2 if name in ("a.json", "e.ndjson") else 1), name
        assert (got[0]["txid"], got[0]["input_addresses"], got[0]["fee"]) == ("t1", ["A", "B"], "1"), name
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.pdf")


def test_untidy_times_numbers_and_addresses(spark):
    from pyspark.sql import functions as F

    rows = [("12:30:00", "5d", "::FFFF:1.2.3.4"), ("T12:30", "1e3", "fe80::1%eth0"), ("2024-01-02", " 7 ", "1.2.3.4%x"), ("2024/01/02 03:04:05", "0x1", "1::2::3")]
    df = spark.createDataFrame(rows, "t string, n string, ip string")
    got = df.select(
        text.parse_timestamp(F.col("t")).cast("string").alias("t"), text.parse_numbers(F.array("n")).alias("n"),
        text.ip_ok(F.col("ip")).alias("ok"), text.normalize_ip(F.col("ip")).alias("ip"),
    ).collect()
    assert [r["t"] for r in got] == [None, None, "2024-01-02 00:00:00", "2024-01-02 03:04:05"]
    assert [r["n"] for r in got] == [[], [1000.0], [7.0], []]
    assert [(r["ok"], r["ip"]) for r in got] == [(True, "::ffff:102:304"), (True, "fe80::1%eth0"), (False, "1.2.3.4%x"), (False, "1::2::3")]
