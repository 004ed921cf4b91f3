import datetime
import hashlib
import json
import random

from pyspark.sql import functions as F

from ledgerlens.operators import stats
from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import streams


def write(path, text):
    path.write_text(text)
    return str(path)


def test_rate_files(spark, tmp_path):
    pfs = write(tmp_path / "pfs.csv", '"2026","01112","05","99213","","90.50","120.25","","","A"\n"2026","01112","05","99999","","0","0","","","A"\nnote,x\n')
    assert [(r.code, r.facility_rate, r.locality, r.carrier) for r in readers.read_pfs(spark, pfs, 2026).collect()] == [("99213", 90.5, "05", "01112")]
    clfs = write(tmp_path / "clfs.csv", 'Preamble\n\nYEAR,HCPCS,MOD,EFF_DATE,INDICATOR,RATE,SHORTDESC,LONGDESC\n2026,80053,,20260101,N,10.56,panel,"long, panel"\n2026,80054,QW,20260101,N,0,zero,zero\n2026,,,20260101,N,1,none,none\n')
    assert [(r.code, r.rate, r.long_desc, r.modifier) for r in readers.read_clfs(spark, clfs, 2026).collect()] == [("80053", 10.56, "long, panel", None)]
    opps = write(tmp_path / "opps.csv", "note\nHCPCS Code,Short Descriptor,SI,APC,Relative Weight,Payment Rate,National Unadjusted Copayment,Minimum Unadjusted Copayment\n70450,ct head,S,5522,1.2,$115.00,23,23\nE1,short,S,1,1,1,1,1\n99285X,long,S,,,,,\n")
    assert [(r.code, r.payment_rate) for r in readers.read_opps(spark, opps, 2026).orderBy("code").collect()] == [("70450", 115.0), ("99285X", None)]
    zips = write(tmp_path / "zip.txt", "CA" + "90210" + "01182" + "18" + " " + "18" + " " * 56 + "20261\nshort\n")
    assert [(r.zip_code, r.carrier, r.locality, r.urban_rural) for r in readers.read_zip_locality(spark, zips).collect()] == [("90210", "01182", "18", "U")]


def test_hospital_prices(spark, tmp_path):
    a = write(tmp_path / "a.csv", 'hospital_name,code,code_type,description,payer,standard_charge|gross,standard_charge|discounted_cash,setting\nMercy,99213,,"visit, office",Aetna,"$1,200.00",-,Both\nMercy,470,MS-DRG,x,,1,1,inpatient\nMercy,80053,CPT,panel,,,,\n')
    got = readers.read_hospital_prices(spark, a, "u").collect()
    assert [(r.billing_code, r.billing_code_type, r.gross_charge, r.cash_discount_price, r.setting, r.payer_name) for r in got] == [("99213", "CPT", 1200.0, None, "both", "Aetna")]
    assert readers.normal_header(" Standard Charge|Gross ($) ") == "standard_charge|gross"


def test_price_files_with_unlike_headers(spark, tmp_path):
    """Headers of all files are read in one job; files of one header are one scan."""
    head = "hospital_name,code,code_type,standard_charge|gross\n"
    paths = [write(tmp_path / f"p{k}.csv", head + f"H{k},9921{k},CPT,{k}.5\n" * 3) for k in range(3)]
    paths.append(write(tmp_path / "q.csv", 'cpt,facility,type,"gross_charge"\n80053,Lab,CPT,"1,000.00"\n'))
    got = sorted((r.hospital_name, r.billing_code, r.gross_charge) for r in readers.read_hospital_prices(spark, paths).distinct().collect())
    assert got == [("H0", "99210", 0.5), ("H1", "99211", 1.5), ("H2", "99212", 2.5), ("Lab", "80053", 1000.0)]
    assert readers.read_hospital_prices(spark, paths).count() == 10


def test_bill_json(spark, tmp_path):
    bill = {"facilityName": "x", "totalBilled": 10.0, "lineItems": [{"cptCode": "99213", "billedAmount": 4.0}, {"lineNumber": 9, "cptCode": "J1100", "billedAmount": 6.0, "units": 2}]}
    head, lines = readers.read_bills(spark, write(tmp_path / "b.json", json.dumps(bill)))
    assert head.first().facility_type == "unknown"
    assert [(r.line_number, r.units) for r in lines.orderBy("line_number").collect()] == [(1, 1.0), (9, 2.0)]
    others = [bill | {"totalBilled": float(k)} for k in range(4)] + [bill]
    for path, multi in ((write(tmp_path / "many.json", "\n".join(map(json.dumps, [*others, bill]))), False), (write(tmp_path / "array.json", json.dumps([*others, bill], indent=1)), True)):
        head, lines = readers.read_bills(spark, path, multi)
        assert head.select("bill_id").distinct().count() == head.count() == 5
        assert sorted(r["count"] for r in lines.groupBy("bill_id").count().collect()) == [2] * 5


def test_eob_json(spark, tmp_path):
    eob = {"insurerName": "Aetna", "planType": "ppo", "totalBilled": 9.0, "lineItems": [{"cptCode": " j1100", "billedAmount": 9.0, "allowedAmount": 4.0}]}
    head, lines = readers.read_eobs(spark, write(tmp_path / "e.json", json.dumps([eob, eob | {"totalBilled": 8.0}], indent=2)), multi_line=True)
    assert sorted((r.plan_type, r.amount_billed) for r in head.collect()) == [("PPO", 8.0), ("PPO", 9.0)]
    r = lines.first()
    assert (r.code, r.line_number, r.allowed_amount, r.copay) == ("J1100", 1, 4.0, 0.0) and lines.select("bill_id").distinct().count() == 2


def test_older_rate_files(spark, tmp_path):
    tabs = write(tmp_path / "old.txt", "HCPCS\tMOD\tDESCRIPTION\tFACILITY FEE\tNON-FACILITY FEE\tLOC\n99213\t\tvisit\t80.00\t$1,100.50\t05\n99999\t26\tnone\t0\t0\t05\n")
    commas = write(tmp_path / "old.csv", 'HCPC,MOD1,DESC,PPAR_FAC_AMOUNT,PPAR_NFAC_AMOUNT,LOCALITY,STATUS\n99214,25,"visit, long",90,,01,A\n')
    want = [("99213", None, 80.0, 1100.5, "05", None), ("99214", "25", 90.0, None, "01", "A")]
    got = [tuple(r) for p in (tabs, commas) for r in readers.read_pfs_with_header(spark, p, 2020).select("code", "modifier", "facility_rate", "non_facility_rate", "locality", "status_indicator").collect()]
    assert got == want
    head = "HCPCS Code,Short Description,HCPCS Code Dosage,Payment Limit,Co-Insurance Percentage,Vaccine AWP%,Vaccine Limit,Blood AWP%,Blood Limit,Clotting Factor,Notes"
    rows = ['j1100,"dexa, inj",1 MG,0.123,20,,,,,,', "J2405,ondansetron,1 MG,NA,20,,,,,,", "J24,short,1 MG,1.5,20,,,,,,", "90700,dtap,0.5 ML,31.2,,,31.2,,,,x"]
    asp = write(tmp_path / "asp.csv", "\n".join(["note"] * 8 + [head, *rows]) + "\n")
    found = readers.read_asp(spark, asp, 2026)
    assert sorted((r.code, r.payment_limit, r.vaccine_limit) for r in found.collect()) == [("90700", 31.2, 31.2), ("J1100", 0.123, None)]
    assert [r.rate_seq for r in found.orderBy("code").collect()] == [r.rate_seq for r in readers.read_asp(spark, asp, 2026).repartition(3).orderBy("code").collect()]


def test_lists_of_hospitals(spark, tmp_path):
    rows = [{"ein": "123456789", "name": "St.  Mary ", "city": "X", "state": "ca", "zip_code": "9021-0"}, {"ein": " ", "name": "none"}, {"ein": "12-3", "name": "B", "state": "NY", "zip_code": "10001-1234"}]
    got = sorted(tuple(r) for r in readers.read_nonprofits(spark, write(tmp_path / "n.json", json.dumps(rows))).select("ein", "name", "state", "zip_code").collect())
    assert got == [("12-3", "B", "NY", "10001"), ("12-3456789", "St. Mary", "CA", "90210")]
    head = "PRVDR_CTGRY_CD,GNRL_CNTL_TYPE_CD,PRVDR_NUM,FAC_NAME,CITY_NAME,STATE_CD,ZIP_CD\n"
    path = tmp_path / "pos.csv"
    path.write_bytes((head + '1,2,050001,San José  "East",X,ca,501\n01,04,050002,Private,X,CA,1\n02,01,050003,Other,X,CA,1\n01,03,050004,Own,X,CA,90210\n').encode("latin-1"))
    got = sorted(tuple(r) for r in readers.read_providers(spark, str(path)).select("ein", "name", "state", "zip_code").collect())
    assert got == [("CMS-050001", 'San José "East"', "CA", "00501"), ("CMS-050004", "Own", "CA", "90210")]
    registry = {"hospitals": [{"name": "A", "aliases": ["AA", "AAA"], "mrf_url": "u", "states": ["CA"]}, {"name": "B"}]}
    got = sorted((r.ord, r.name) for r in readers.read_registry(spark, write(tmp_path / "r.json", json.dumps(registry))).collect())
    assert got == [(0, "A"), (0, "AA"), (0, "AAA"), (1, "B")]


def test_documents_and_fingerprints(spark, tmp_path):
    path = write(tmp_path / "d.txt", "one\ntwo")
    r = readers.read_documents(spark, path).first()
    assert r.text == "one\ntwo" and r.confidence == 0.95
    assert readers.fingerprints(spark, path).first().data_hash == "sha256:" + hashlib.sha256(b"one\ntwo").hexdigest()


def test_digest_trees_of_any_split(spark, tmp_path):
    rng = random.Random(1)
    folder = tmp_path / "big"
    folder.mkdir()
    size = 1 << 12
    for name, n in (("a", 10 * size + 17), ("b", size), ("c", 0), ("d", 3 * size), ("e", 5)):
        (folder / f"{name}.bin").write_bytes(rng.randbytes(n))

    def tree(raw):
        parts = [raw[k : k + size] for k in range(0, len(raw), size)] or [b""]
        return "sha256-tree:" + hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()

    want = {f.name: (f.stat().st_size, tree(f.read_bytes())) for f in folder.iterdir() if f.name != "c.bin"}
    for tasks in (1, 3, 16):
        assert {r.path.rsplit("/", 1)[1]: (r.length, r.data_hash) for r in readers.tree_fingerprints(spark, str(folder), size, tasks).collect()} == want
    assert {r.data_hash for r in readers.tree_fingerprints(spark, str(folder / "a.bin"), size + 1).collect()} != {want["a.bin"][1]}


def test_files_of_one_folder_with_other_headers(spark, tmp_path):
    folder = tmp_path / "opps"
    folder.mkdir()
    write(folder / "1.csv", "note\nHCPCS Code,Short Descriptor,SI,APC,Relative Weight,Payment Rate,National Unadjusted Copayment,Minimum Unadjusted Copayment\n70450,ct head,S,5522,1.5,$106.00,,21.2\n")
    write(folder / "2.csv", "other note\nmore\nHCPCS Code,Payment Rate,Short Descriptor,APC,SI,Minimum Unadjusted Copayment,National Unadjusted Copayment,Relative Weight\n70551,230.5,mri,5523,S,1,2,3\n")
    got = sorted((r.code, r.short_desc, r.apc, r.payment_rate, r.min_copay) for r in readers.read_opps(spark, str(folder), 2026).collect())
    assert got == [("70450", "ct head", "5522", 106.0, 21.2), ("70551", "mri", "5523", 230.5, 1.0)]
    folder = tmp_path / "pfs"
    folder.mkdir()
    write(folder / "1.txt", "HCPCS\tMOD\tDESCRIPTION\tFACILITY FEE\tNON-FACILITY FEE\tLOC\n99213\t\tvisit\t80.00\t$1,100.50\t05\n")
    write(folder / "2.csv", 'HCPC,DESC,MOD1,PPAR_NFAC_AMOUNT,PPAR_FAC_AMOUNT,LOCALITY\n99214,"visit, long",25,7,90,01\n')
    got = sorted((r.code, r.modifier, r.description, r.facility_rate, r.non_facility_rate) for r in readers.read_pfs_with_header(spark, str(folder), 2020).collect())
    assert got == [("99213", None, "visit", 80.0, 1100.5), ("99214", "25", "visit, long", 90.0, 7.0)]


def test_loads_that_repeat_or_stop(spark, tmp_path):
    rates = spark.createDataFrame([("99213", 1.0), ("99214", 2.0)], "code string, rate double")
    table, snaps, when = str(tmp_path / "rates"), str(tmp_path / "snaps"), datetime.datetime(2026, 1, 1)
    assert [sinks.append_load(rates, table, snaps, k, "clfs", 2026, when, "h") for k in (1, 2, 1)] == [2, 2, 2]
    assert spark.read.parquet(snaps).count() == 1 and sinks.committed(spark, table, snaps).count() == 2
    # a load that stopped after its rows, before its snapshot
    rates.unionByName(rates).write.parquet(f"{table}/snapshot_id=3")
    assert spark.read.parquet(table).count() == 6 and sinks.committed(spark, table, snaps).count() == 2
    assert sinks.append_load(rates.limit(1), table, snaps, 3, "clfs", 2026, when, "h2") == 1
    assert sorted((r.snapshot_id, r.code) for r in sinks.committed(spark, table, snaps).collect()) == [(1, "99213"), (1, "99214"), (3, "99213")]


def test_merge_rewrites_only_what_new_keys_touch(spark, tmp_path):
    table = str(tmp_path / "t")
    files = lambda: {p.relative_to(table): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    rows = spark.range(500).selectExpr("cast(id AS string) AS k", "id AS o", "'old' AS v")
    sinks.create_table(rows.unionByName(rows.withColumn("o", F.col("o") - 1000)), table, ["k"], "o", 32)
    before = files()
    new = spark.createDataFrame([("7", 1, "x"), ("7", 2, "new"), ("900", 1, "new"), (None, 1, "null")], "k string, o long, v string")
    n = sinks.merge_into(new, table, ["k"], "o", 32)
    after = files()
    assert 1 <= n <= 3 and len(before.keys() & after.keys()) == len(before) - n and all(before[f] == after[f] for f in before.keys() & after.keys())
    got = {r.k: r.v for r in spark.read.parquet(table).collect()}
    assert len(got) == 502 and got["7"] == "new" and got["900"] == "new" and got["8"] == "old" and got[None] == "null"
    sinks.merge_into(spark.createDataFrame([("7", 9, "ignored"), ("901", 1, "added")], "k string, o long, v string"), table, ["k"], "o", 32, ignore=True)
    got = {r.k: r.v for r in spark.read.parquet(table).collect()}
    assert got["7"] == "new" and got["901"] == "added" and len(got) == 503
    assert sinks.merge_into(new.limit(0), table, ["k"], "o", 32) == 0


def test_state_of_silent_keys_expires(spark, tmp_path):
    src, held = tmp_path / "quota", []
    batches = [[(u, 10 + u % 5) for u in range(50)], [(99, 500)], [(99, 5000), (3, 5001)], [(99, 5010), (99, 5011), (99, 5012)]]
    for part in batches:
        spark.createDataFrame(part, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("created_at")).coalesce(1).write.mode("append").json(str(src))
        events = spark.readStream.schema("user_id long, created_at timestamp").json(str(src))
        q = streams.quota_stream(events, 60, 2).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "counts"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert held[0] >= 50 and held[-1] <= 2
    got = spark.read.parquet(str(tmp_path / "counts")).groupBy("user_id").agg(F.sum("accepted"), F.sum("rejected")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_quota([x for part in batches for x in part], 60, 2)


def test_rollup_kept_by_a_stream_equals_a_full_scan(spark, tmp_path):
    rng = random.Random(6)
    src = tmp_path / "events"
    src.mkdir()
    kinds = ["page_view", "audit", "signup", "upgrade", "feature_use", "share"]
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(31), hours=rng.choice([0, 0, 5, 23]), minutes=rng.choice([0, 0, 59]))
    for k in range(3):
        rows = [{"event_type": rng.choice(kinds), "event_data": rng.choice(['{"k": "3"}', '{"k": "7.5"}', "{}", "no json"]), "user_id": rng.randrange(5), "created_at": str(at())} for _ in range(150)]
        write(src / f"{k}.json", "\n".join(map(json.dumps, rows)))
        streams.maintain_rollup(readers.read_events(spark, str(src), streaming=True), str(tmp_path / "rollup"), str(tmp_path / "cp")).awaitTermination()
    events, rollup, as_of = readers.read_events(spark, str(src)), spark.read.parquet(str(tmp_path / "rollup")), F.lit("2024-01-31").cast("timestamp")
    assert rollup.select("batch").distinct().count() == 3
    same = lambda a, b: sorted(map(str, (r.asDict() for r in a.collect()))) == sorted(map(str, (r.asDict() for r in b.collect())))
    assert same(stats.page_views(events, as_of), stats.page_views_of(rollup, as_of)) and same(stats.audit_events(events, as_of), stats.audit_events_of(rollup, as_of))
    assert same(stats.event_trend(events, as_of), stats.event_trend_of(rollup, as_of))


def test_overwrite_while_reading(spark, tmp_path):
    table = str(tmp_path / "t")
    spark.range(3).write.parquet(table)
    for _ in range(2):
        sinks.overwrite_safely(spark, spark.read.parquet(table).select((F.col("id") + 1).alias("id")), table)
        spark.catalog.refreshByPath(table)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [2, 3, 4]
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    sinks.overwrite_safely(spark, spark.range(1), str(tmp_path / "fresh"))
    assert spark.read.parquet(str(tmp_path / "fresh")).count() == 1


def test_loads_and_sources(spark, tmp_path):
    rates = spark.createDataFrame([("99213", 1.0), ("99214", 2.0)], "code string, rate double")
    table, snaps = str(tmp_path / "rates"), str(tmp_path / "snaps")
    assert sinks.append_load(rates, table, snaps, 7, "clfs", 2026, datetime.datetime(2026, 1, 1), "h") == 2
    assert spark.read.parquet(snaps).first().row_count == 2
    prices = spark.createDataFrame([(1, "a"), (2, "b")], "source_id int, v string")
    out = str(tmp_path / "prices")
    sinks.replace_source(prices, out)
    sinks.replace_source(spark.createDataFrame([(2, "c")], "source_id int, v string"), out)
    assert sorted((r.source_id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]


def test_streams(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    rows = [("page_view", "2024-01-01 10:00:00", 1), ("audit", "2024-01-02 09:00:00", 1), ("other", "2024-01-02 09:00:00", 1), ("audit", "2024-01-09 09:00:00", 2)]
    write(src / "1.json", "\n".join(json.dumps({"event_type": t, "created_at": c, "user_id": u}) for t, c, u in rows))
    events = readers.read_events(spark, str(src), streaming=True)
    streams.store_events(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = streams.daily_counts(events).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    write(src / "2.json", json.dumps({"event_type": "audit", "created_at": "2024-01-01 11:00:00", "user_id": 3}))  # late by more than a day
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.day), r.event_type, r.n) for r in spark.table("daily").collect()) == [("2024-01-01", "page_view", 1), ("2024-01-02", "audit", 1)]


def brute_quota(rows, span, quota):
    """Accepted and rejected events per user, event after event."""
    out = {}
    for user in {u for u, _ in rows}:
        start, used, ok, no = None, 0, 0, 0
        for t in sorted(t for u, t in rows if u == user):
            if start is None or t > start + span:
                start, used = t, 0
            used += 1
            ok, no = (ok + 1, no) if used <= quota else (ok, no + 1)
        out[user] = (ok, no)
    return out


def test_quota(spark, tmp_path):
    assert streams.take([0, 10, 59, 60, 61, 100], 0.0, 0, 60, 2)[0] == [True, True, False, False, True, True]
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(0, 4000)) for _ in range(600)]
    d = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("created_at"))
    assert {r[0]: (r[1], r[2]) for r in streams.quota_batch(d, 60, 2).collect()} == brute_quota(rows, 60, 2)
    # the same as a stream of two files, the second later in time
    src = tmp_path / "quota"
    later = [(u, t) for u, t in rows if t >= 2000]
    q = None
    for k, part in enumerate(([(u, t) for u, t in rows if t < 2000], later)):
        spark.createDataFrame(part, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("created_at")).coalesce(1).write.mode("append").json(str(src))
        events = spark.readStream.schema("user_id long, created_at timestamp").json(str(src))
        q = streams.quota_stream(events, 60, 2).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "counts"))).option("checkpointLocation", str(tmp_path / "cpq")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "counts")).groupBy("user_id").agg(F.sum("accepted"), F.sum("rejected")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_quota(rows, 60, 2)


def test_bill_and_statement_rows_are_lines_with_their_heads(spark, tmp_path):
    """One pass over the records: the rows of the join of heads and lines, a repeated record once, none without lines."""
    (tmp_path / "a.json").write_text('{"facilityName":"A","totalBilled":5,"lineItems":[{"cptCode":"1"},{"cptCode":"2","units":3}]}\n' * 2 + '{"facilityName":"B","lineItems":[]}\n')
    head, lines = readers.read_bills(spark, str(tmp_path))
    got = readers.read_bill_rows(spark, str(tmp_path))
    key = lambda d: sorted((r.facility_name, r.facility_type, r.total_billed, r.line_number, r.code, r.units) for r in d.collect())
    assert key(got) == key(head.join(lines, "bill_id")) == [("A", "unknown", 5.0, 1, "1", 1.0), ("A", "unknown", 5.0, 2, "2", 3.0)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text('{"claimNumber":"9","planType":"ppo","totalPatientResponsibility":4,"lineItems":[{"cptCode":"j1","patientResponsibility":2}]}\n')
    r = readers.read_eob_rows(spark, str(tmp_path / "e")).first()
    assert (r.claim_number, r.plan_type, r.total_patient_responsibility, r.code, r.patient_responsibility, r.copay) == ("9", "PPO", 4.0, "J1", 2.0, 0.0)
