"""Raw CSV exports -> Tables -> every report, end to end."""

from __future__ import annotations

import os

import pytest

from shop_tables import money
from shoplens.plans.catalog import REPORTS, run_reports
from shoplens.sources.csv_tables import from_csv_folder


def _write(folder, name, header, rows):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(header + "\r\n")
        for r in rows:
            f.write(",".join(r) + "\r\n")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("csv"))
    _write(d, "customers.csv", "customer_id,customer_unique_id,zip_code_prefix,city,state", [
        ("c1", "u1", "01001", '"sao paulo"', "SP"),
        ("c2", "u1", "01002", "\"D'Oeste\"", "RO"),
        ("c3", "u2", "20000", "rio", "RJ"),
        ("c4", "u3", "30000", "belo horizonte", "MG"),
        ("c5", "u4", "40000", "salvador", "BA")])
    head = ("order_id,customer_id,status,purchase_timestamp,approval_timestamp,delivered_carrier_date,"
            "delivered_customer_date,estimated_delivery_date")
    _write(d, "orders.csv", head, [
        ("o1", "c1", "delivered", "2018-01-05 10:00:00", "", "", "", ""),
        ("o2", "c2", "delivered", "2018-06-01 10:00:00", "", "", "", ""),
        ("o3", "c3", "delivered", "2018-03-01 10:00:00", "", "", "", ""),
        ("o4", "c3", "delivered", "2018-10-01 10:00:00", "", "", "", ""),
        ("o5", "c3", "canceled", "2018-10-02 10:00:00", "", "", "", ""),
        ("o6", "c4", "delivered", "2018-09-01 10:00:00", "", "", "", ""),
        ("o7", "c5", "shipped", "2018-11-01 10:00:00", "", "", "", "")])
    _write(d, "order_payments.csv",
           "order_id,payment_sequential,payment_type,payment_installments,payment_value", [
               ("o1", "1", "credit_card", "1", "100.00"), ("o2", "1", "boleto", "1", "50.50"),
               ("o2", "2", "voucher", "1", "9.50"), ("o3", "1", "credit_card", "3", "20.00"),
               ("o4", "1", "credit_card", "1", "30.00"), ("o6", "1", "debit_card", "1", "500.00")])
    _write(d, "order_items.csv",
           "order_id,item_id,product_id,seller_id,shipping_limit_date,price,freight_value", [
               ("o1", "1", "p1", "s1", "2018-01-06 00:00:00", "90.00", "10.00"),
               ("o2", "1", "p2", "s1", "", "60.00", "0.00"),
               ("o3", "1", "p1", "s2", "", "20.00", "0.00"),
               ("o4", "1", "p3", "s2", "", "30.00", "0.00"),
               ("o6", "1", "p2", "s1", "", "250.00", "0.00"),
               ("o6", "2", "p1", "s1", "", "250.00", "0.00")])
    _write(d, "products.csv",
           "product_id,product_category,name_length,description_length,photos_quantity,weight_g,"
           "length_cm,height_cm,width_cm", [
               ("p1", "cama_mesa_banho", "", "", "", "", "", "", ""),
               ("p2", "brinquedos", "", "", "", "", "", "", ""),
               ("p3", "sem_dicionario", "", "", "", "", "", "", "")])
    _write(d, "category_names_english.csv", "product_category,product_category_eng", [
        ("cama_mesa_banho", "bed_bath_table"), ("brinquedos", "toys")])
    _write(d, "sellers.csv", "seller_id,zip_code_prefix,city,state", [("s1", "1001", "x", "SP")])
    _write(d, "order_reviews.csv",
           "review_id,order_id,rating,review_title,review_content,creation_timestamp,answer_timestamp",
           [("r1", "o1", "5", "", "", "", ""), ("r2", "o_missing", "1", "", "", "", ""),
            ("r3", "o1", "five", "", '"a\nb"', "", "")])
    return from_csv_folder(spark, d, import_to=str(tmp_path_factory.mktemp("loaded")))


def test_every_report_runs(tables):
    reports = run_reports(tables)
    assert set(reports) == set(REPORTS)
    for name, df in reports.items():
        df.collect()


def test_values(tables):
    r = run_reports(tables, ["customer_master", "funnel_rates", "cohort_lift", "monthly_sales"])
    m = {x.customer_unique_id: x for x in r["customer_master"].collect()}
    assert m["u1"].customer_id == "c2" and m["u1"].clean_city == "d oeste" and m["u1"].order_cnt == 2
    assert m["u1"].delivered_order_cnt == 2 and m["u1"].sales == 160.0 and m["u1"].repeat_customer == 1
    assert m["u4"].active_customer == 0 and m["u4"].sales == 0.0
    f = r["funnel_rates"].collect()[0]
    assert (f.order_customer_cnt, f.delivered_customer_cnt, f.repeat_customer_cnt) == (4, 3, 2)
    assert f.repeat_rate == 0.6667
    months = {x.year_m: x.sales for x in r["monthly_sales"].collect()}
    assert months == {"2018-01": 100.0, "2018-06": 60.0, "2018-03": 20.0, "2018-10": 30.0, "2018-09": 500.0}


def test_write_reports(tables, tmp_path):
    from shoplens.plans.run import write_reports
    out = str(tmp_path / "out")
    paths = write_reports(run_reports(tables, ["bcg_quadrants", "cohort_lift"]), out, "csv")
    assert sorted(os.path.basename(p) for p in paths) == ["bcg_quadrants", "cohort_lift"]
    assert any(f.endswith(".csv") for f in os.listdir(paths[0]))


def test_all_nine_raw_schemas_load(spark, tmp_path):
    from shoplens.sources import schemas
    from shoplens.sources.files import load_csv
    samples = {
        "geolocation": ("zip_code_prefix,latitude,longitude,city,state", "01037,-23.5456,-46.6392,sao paulo,SP"),
        "customers": ("customer_id,customer_unique_id,zip_code_prefix,city,state", "c1,u1,01001,x,SP"),
        "sellers": ("seller_id,zip_code_prefix,city,state", "s1,13023,campinas,SP"),
        "orders": ("order_id,customer_id,status,purchase_timestamp,approval_timestamp,delivered_carrier_date,"
                   "delivered_customer_date,estimated_delivery_date", "o1,c1,delivered,2017-10-02 10:56:33,,,,"),
        "order_reviews": ("review_id,order_id,rating,review_title,review_content,creation_timestamp,answer_timestamp",
                          'r1,o1,4,,"bom, mas ""lento""\nok",2018-01-18 00:00:00,'),
        "order_payments": ("order_id,payment_sequential,payment_type,payment_installments,payment_value",
                           "o1,1,credit_card,8,99.33"),
        "category_names_english": ("product_category,product_category_eng", "beleza_saude,health_beauty"),
        "products": ("product_id,product_category,name_length,description_length,photos_quantity,weight_g,"
                     "length_cm,height_cm,width_cm", "p1,perfumaria,40,287,1,225,16,10,14"),
        "order_items": ("order_id,item_id,product_id,seller_id,shipping_limit_date,price,freight_value",
                        "o1,1,p1,s1,2017-09-19 09:45:35,58.90,13.29"),
        "cross_tab": ("category_group,star_cnt,one_time_cnt", "Home & Living,383,25392"),
    }
    for table, (head, row) in samples.items():
        p = str(tmp_path / f"{table}.csv")
        with open(p, "w", newline="") as f:
            f.write(head + "\n" + row + "\n")
        df = load_csv(spark, p, table)
        rows = df.collect()
        assert len(rows) == 1, table
        assert [f.name for f in df.schema.fields] == [f.name for f in schemas.TABLES[table].fields]
        assert all(v is not None for k, v in rows[0].asDict().items()
                   if k in head.split(",")[:2]), table
    review = load_csv(spark, str(tmp_path / "order_reviews.csv"), "order_reviews").collect()[0]
    assert review.review_content == 'bom, mas "lento"\nok' and review.review_title is None
    seller = load_csv(spark, str(tmp_path / "sellers.csv"), "sellers").collect()[0]
    assert seller.zip_code_prefix == "13023"
    pay = load_csv(spark, str(tmp_path / "order_payments.csv"), "order_payments").collect()[0]
    assert str(pay.payment_value) == "99.33"


def test_integrity_includes_optional_tables(tables):
    got = {(r.kind, r.table_name, r.column_name): r.violations
           for r in run_reports(tables, ["integrity_report"])["integrity_report"].collect()}
    assert got[("fk", "order_items", "seller_id")] == 2          # the two item rows of seller s2
    assert got[("fk", "order_reviews", "order_id")] == 1
    assert got[("pk", "sellers", "seller_id")] == 0
    assert got[("fk", "products", "product_category")] == 1      # sem_dicionario


def test_single_line_files_are_split(spark, tmp_path):
    from shoplens.sources.files import load_csv
    rows = "\n".join(f"o{i},1,credit_card,1,{i % 100}.50" for i in range(60_000))
    path = tmp_path / "order_payments.csv"
    path.write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\n" + rows + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        df = load_csv(spark, str(path), "order_payments", multi_line=False)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 60_000
        assert load_csv(spark, str(path), "order_payments").count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("table", ["customers", "order_payments", "products", "order_items", "sellers", "geolocation",
                                   "category_names_english", "orders", "order_reviews"])
def test_quoted_line_break_in_every_file(spark, tmp_path, table):
    from shoplens.sources import schemas
    from shoplens.sources.files import load_csv
    fields = schemas.TABLES[table].fields
    strings = [f.name for f in fields if f.dataType.simpleString() == "string"]
    field = strings[-1]
    row = ['"two\nlines, ""quoted"""' if f.name == field else ("x" if f.name in strings else "") for f in fields]
    path = tmp_path / f"{table}.csv"
    path.write_text(",".join(f.name for f in fields) + "\n" + ",".join(row) + "\n" + ",".join(row) + "\n")
    rows = load_csv(spark, str(path), table).collect()
    assert [r[field] for r in rows] == ['two\nlines, "quoted"'] * 2


def test_import_sets_broken_records_apart(spark, tmp_path):
    from shoplens.sources.files import import_table, imported
    path = tmp_path / "order_payments.csv"
    head = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    path.write_text(head + 'o1,1,card,1,10.00\no2,1,card,1,ten\n"o3","one","a\nb",1,3.00\no4,1,card,1,\no5,1,card\no6,1,c,1,2.00,x\n')
    good, bad = import_table(spark, str(path), "order_payments", str(tmp_path / "out"))
    assert sorted((r.order_id, r.payment_value) for r in good.collect()) == [("o1", money("10.00")), ("o4", None)]
    got = {r.record: (r.table_name, r.reason, r.source_file.rsplit("/", 1)[1]) for r in bad.collect()}
    at = "order_payments.csv"
    assert got == {"o2,1,card,1,ten": ("order_payments", "payment_value: not decimal(10,2): ten", at),
                   '"o3","one","a\nb",1,3.00': ("order_payments", "payment_sequential: not int: one", at),
                   "o5,1,card": ("order_payments", "number of fields is not 5", at),
                   "o6,1,c,1,2.00,x": ("order_payments", "number of fields is not 5", at)}
    assert "csv" not in good._jdf.queryExecution().toString().lower().replace(at, "")
    path.write_text(head + "o1,1,card,1,10.00\n")                       # loaded again: nothing of the first load stays
    good, bad = import_table(spark, str(path), "order_payments", str(tmp_path / "out"))
    assert good.count() == 1 and bad.count() == 0
    path.write_text(head)
    import_table(spark, str(path), "order_payments", str(tmp_path / "empty"))
    assert [x.count() for x in imported(spark, str(tmp_path / "empty"), "order_payments")] == [0, 0]


def test_rejected_records_are_counted(spark, tmp_path):
    from shoplens.sources.files import load_csv, rejected_rows
    path = tmp_path / "order_payments.csv"
    path.write_text("order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
                    "o1,1,card,1,10.00\no2,1,card,1,ten\no3,one,card,1,3.00\no4,1,card,1,\no5,1,card\n")
    assert rejected_rows(spark, str(path), "order_payments").first().rejected == 3
    assert load_csv(spark, str(path), "order_payments").count() == 5


def test_integrity_report_counts_rejects(tables):
    rows = run_reports(tables, ["integrity_report"])["integrity_report"].where("kind = 'reject'").collect()
    assert {r.table_name: r.violations for r in rows} == {
        t: int(t == "order_reviews") for t in ("customers", "orders", "order_payments", "order_items", "products", "category_names_english",
                       "sellers", "order_reviews")}


def test_reject_records_of_a_folder(tables):
    r, = tables.extra["reject_records"].collect()
    assert (r.table_name, r.reason) == ("order_reviews", "rating: not int: five") and r.record == 'r3,o1,five,,"a\nb",,'
    assert tables.extra["raw_tables"]["order_reviews"].count() == 2


def test_uris_are_found(spark, tmp_path):
    from shoplens.sources.files import exists
    (tmp_path / "a.csv").write_text("x\n")
    assert exists(spark, f"file://{tmp_path}/a.csv") and exists(spark, str(tmp_path / "a.csv"))
    assert not exists(spark, f"file://{tmp_path}/b.csv")
