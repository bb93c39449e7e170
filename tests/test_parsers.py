import pytest
from pyspark.sql import functions as F

from quadrel.functions import parsers, wikitext

CASES = [
    ("date", "khai giảng 3/9/1988", ["1988-09-03"]),
    ("date", "5-11-2004 (lần hai)", ["2004-11-05"]),
    ("date", "ngày 7 tháng 1 năm 1931", ["1931-01-07"]),
    ("date", "19 tháng 8, 1945", ["1945-08-19"]),
    ("date", "1999-2-3", ["1999-02-03"]),
    ("date", "{{Ngày sinh và tuổi khác|2001|4|9}}", ["2001-04-09"]),
    ("date", "khoảng năm 1076", ["1076"]),
    ("date", "30/2/2011 và 1990", []),
    ("date", "2500", []),
    ("int", "12,340 sinh viên", ["12340"]),
    ("int", "1.250.000 cuốn", ["1250000"]),
    ("int", "3 450", ["3450"]),
    ("int", "7,25", []),
    ("int", "x4,500", []),
    ("int", None, []),
    ("area_m2", "3.217,5", ["3217500000.0"]),
    ("area_m2", "2,345.5 km²", ["2345500000.0"]),
    ("area_m2", "12 ha", ["120000.0"]),
    ("area_m2", "5 hecta", ["50000.0"]),
    ("area_m2", "800 m2", ["800.0"]),
    ("area_m2", "2,345,678", []),
    ("area_m2", "2.345", ["2345000000.0"]),
    ("float", "cao -3.50 m", ["-3.5"]),
    ("code", "QSB<ref>x</ref>", ["QSB"]),
    ("code", "{{Màu chữ|red|''BKA''}}", ["BKA"]),
    ("code_list", "A1; B2, C3", ["A1", "B2", "C3"]),
    ("text", ' "Dạy tốt" ', ["Dạy tốt"]),
    ("text_list", "x, y; z\n* w 2,5", ["x", "y", "z", "w 2,5"]),
    ("person_name", "GS. TSKH. Phan Thị Mai", ["Phan Thị Mai"]),
    ("person_name", "[[Thạc sĩ|ThS]]. [[Đỗ Minh Quân]] (từ 2011)", ["Đỗ Minh Quân"]),
    ("person_name", "đang trống<br>TS. Vũ Hoài An", ["Vũ Hoài An"]),
    ("person_name", "Hồ Văn Bảy Tiến sĩ", ["Hồ Văn Bảy"]),
    ("person_link", "[[Thạc sĩ|ThS]]. [[Đỗ Minh Quân]]", ["Đỗ Minh Quân"]),
    ("person_link", "[[Đỗ Minh Quân (nhà văn)|Đỗ Minh Quân]]", []),
    ("ownership", "Đại học tư thục", ["private"]),
    ("ownership", "trường [[công lập]]", ["public"]),
    ("ownership", "tư thục, 100% vốn của nước khác", ["foreign"]),
    ("url", "xem www.z.edu.vn/a).", ["http://www.z.edu.vn/a"]),
    ("url", "[http://w.vn/b Trang chủ] www.c.vn", ["http://w.vn/b"]),
    ("links", "[[huyện C#y|C]] và [[Tập tin:q.jpg|nhỏ|[[Xã D]]]] [[GS. TS.]]", ["Huyện C", "Xã D"]),
    ("first_link", "[[a]] [[b]]", ["A"]),
    ("coord", "{{Coord|12.5|-108.25}}", ["12.5 -108.25"]),
    ("coord", "{{nowrap|{{tọa độ|x}} {{Coord|12.5|108.25}}}}", ["12.5 108.25"]),
    ("coord", "21.0285; 105.8542", ["21.0285 105.8542"]),
    ("coord", "95.5, 10.5", []),
    ("coord", "{{Coord|12|x|N|3|4|E}}", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, raw) for i, (_, raw, _) in enumerate(CASES)], "i int, raw string").withColumn("m", parsers.scanned(F.col("raw")))
    out = rows.select("i", *(parsers.of(F.col("m"), name).alias(name) for name in parsers.PARSERS)).collect()
    return {(r.i, name): [x.v for x in r[name]] for r in out for name in parsers.PARSERS}


def test_parsers(found):
    assert [(name, raw, found[i, name]) for i, (name, raw, _) in enumerate(CASES)] == CASES


def test_degrees(spark):
    raws = ["{{Coord|20|59|30.6|N|105|48|3.6|E}}", "20°59'30.6\"N 105°48'3.6\"E", "{{coord|20|59.51|S|105|48.06|W}}"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").select("i", parsers.parsed(F.col("raw"), "coord").alias("v")).orderBy("i").collect()
    for r, sign in zip(rows, (1, 1, -1), strict=True):
        assert abs(r.v[0].lat - sign * 20.991833) < 1e-5 and abs(r.v[0].lon - sign * 105.801) < 1e-5


def test_own_parser(spark):
    parsers.register("upper", lambda m: F.transform(F.array(F.upper(m["text"])), lambda x: parsers._value(x)).cast(parsers.VALUE))
    try:
        assert spark.createDataFrame([("a b",)], "raw string").select(parsers.parsed(F.col("raw"), "upper").alias("v")).first().v[0].v == "A B"
    finally:
        del parsers.PARSERS["upper"]


def test_wikitext():
    page = """{{Thông tin trường học|tên = '''Trường''' {{nowrap|A}} |Thành lập={{start date|1999|1|2}}|website=[http://a.vn A]|label1=Khẩu hiệu|data1=Học<!-- x -->}}
'''Trường A''' là [[trường]] ở [[Hà Nội|thủ đô]].<ref>z</ref> {{x}}
[[Tập tin:a.jpg|nhỏ|chú [[thích]]]]
== Mục ==
[[Thể loại:Trường]] [[Category:B|c]]"""
    ((name, params),) = wikitext.infoboxes(page)
    assert name == "Thông tin trường học" and params["khẩu hiệu"] == "Học" and wikitext.plain(params["tên"]) == "Trường A"
    assert wikitext.lead(page) == "Trường A là trường ở thủ đô."
    assert wikitext.categories(page) == ["Trường", "B"]
    assert ("Hà Nội", "thủ đô") in wikitext.links(page) and wikitext.lead("a " * 3000).endswith("a…")
    assert wikitext.plain("{{a|[[b") != "" and wikitext.plain(None) == ""


def test_deep_markup():
    assert wikitext.plain("{{nowrap|" * 2000 + "x" + "}}" * 2000) == "x"
    assert wikitext.plain("[[a|" * 2000 + "x" + "]]" * 2000) == "x" and len(wikitext.links("[[a|" * 2000 + "x" + "]]" * 2000)) == 2000
    assert len(wikitext.plain("{{" * 50_000)) == 100_000
