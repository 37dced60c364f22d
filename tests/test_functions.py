import pytest
from pyspark.sql import functions as F

from pricegrain.functions import money as M
from pricegrain.functions import text as X



@pytest.mark.parametrize(
    "f, text, want",
    [
        (X.total_capacity_gb, "Kit 32GB (2x16GB)", 32), (X.total_capacity_gb, "[2 x 16GB] kit", 16), (X.total_capacity_gb, "600TBW 6Gb/s", None), (X.total_capacity_gb, "SSD 2TB", 2048),
        (X.speed_mhz, "PC5-48000", None), (X.speed_mhz, "DDR5-6000 (PC5-48000) 5600MHz", 6000), (X.speed_mhz, "6400 MT/s", 6400), (X.ssd_type, "M.2 SATA SSD", "SATA"), (X.ssd_type, "NVMe", "NVMe"), (X.ssd_type, "SSD", None),
        (X.form_factor, '2.5" M.2', "M.2"), (X.form_factor, "2.5in", '2.5"'), (X.latency, "ram CL 36 x", "CL36"), (X.latency, "ram", None), (X.ram_type, "ddr4 kit", "DDR4"),
        (X.part_number, "RAM (CMK32GX5M2B6000C36)", "CMK32GX5M2B6000C36"), (X.part_number, "Samsung MZ 77E1T0BW", None), (X.part_number, "Evo MZ-77E1T0BW", "MZ-77E1T0BW"), (X.part_number, "kit DDR5-6000", None),
        (X.brand_of, "WD_BLACK SN850X", "Western Digital"), (X.brand_of, "CT2K48G56C46S5", "Crucial"), (X.brand_of, "nothing", None), (X.slugify, " A--b & C ", "a-b-c"), (X.normal_mpn, "ab-1/2", "AB12"),
        (X.masked_email, "someone@x.co", "so***@x.co"), (X.masked_email, "none", "(none)"), (X.leading_number, "12.50 USD", 12.5), (X.leading_number, "USD 1", None), (X.pcie_generation, "PCIe Gen4 x4", "g4"), (X.pcie_generation, "x", ""),
        (X.escaped, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"), (X.uri_component, "a b/!'()*~", "a%20b%2F!'()*~"), (X.large_image, "x._AC_SL500_.jpg", "x._AC_SL1200_.jpg"), (X.is_external, "USB stick", True), (X.is_token, "a" * 64, True), (X.is_token, "A" * 64, False),
    ],
)
def test_text(one, f, text, want):
    assert one(f(F.col("c")), c=text) == want


def test_labels(one):
    assert one(X.capacity_label(F.col("c")), c=1024) == "1TB" and one(X.capacity_label(F.col("c")), c=1536) == "1536GB"
    assert [one(X.speed_band(F.col("c")), c=v) for v in (6000, 5600, 5200, 4800)] == ["6000MHz+", "5600MHz", "5200MHz", "4800MHz & below"]


def test_segments(one):
    of = lambda cat, name: one(X.segment(F.col("a"), F.col("b")), a=cat, b=name)
    assert of("ram", "DDR5 kit") == "ddr5" and of("ssd", "2.5 SATA") == "sata_ssd" and of("ssd", "NVMe") == "nvme_ssd" and of("ram", "kit") is None and of("gpu", "DDR5") is None


def test_search(one):
    assert one(X.matches_query("gskill", F.col("c")), c="G.Skill") and one(X.matches_query("g skill", F.col("c")), c="G.Skill") and not one(X.matches_query("", F.col("c")), c="G.Skill")


def test_signature(one):
    s = one(X.line_signature(F.col("n"), F.col("b")), n="Corsair Vengeance RGB 32GB (2x16GB) DDR5-6000 CL36 Desktop Memory CMK32GX5M2B6000C36 7,450MB/s", b="Corsair")
    assert s == ["vengeance", "rgb"]
    assert one(X.line_key(F.lit("ram"), F.lit("Corsair"), F.col("n")), n="Corsair 32GB DDR5") is None


def test_names(one):
    short = lambda n, b: one(X.short_name(F.col("n"), F.col("b")), n=n, b=b)
    assert short("Trident Z5 (RGB), x", "G.Skill") == "G.Skill Trident Z5" and short("Corsair Vengeance, DDR5", "Corsair") == "Corsair Vengeance"
    long = short("abcdefghijklmnopqrstuvwxyz abcdefghijklmnopqrstuvwxyz", "")
    assert long == "abcdefghijklmnopqrstuvwxyz"
    assert short("x" * 60, "") == "x" * 41
    assert one(X.cap_words(F.col("c"), 10), c="hello wonderful") == "hello wond"[:5] or one(X.cap_words(F.col("c"), 10), c="hello wonderful") == "hello wond"


def test_highlight(one):
    tokens = F.array(F.lit("skill"), F.lit("g"), F.lit("ill z"))
    assert one(X.highlighted(F.col("c"), tokens), c="G.Skill Z5 <x>") == "<strong>G</strong>.<strong>Skill Z</strong>5 &lt;x&gt;"


def test_highlight_against_plain_walk(spark):
    names = ["the then", "other", "an erther an", "", "ththe"]
    tokens = ["the", "ththe", "an", "er"]
    got = {r["n"]: [(x["a"], x["b"]) for x in r["r"]] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", X.highlight_ranges(F.col("n"), X.one_of(tokens)).alias("r")).collect()}
    for n in names:
        spans = sorted((n.find(t), n.find(t) + len(t)) for t in tokens if t in n)
        want: list[tuple[int, int]] = []
        for a, b in spans:
            if want and a <= want[-1][1]:
                want[-1] = (want[-1][0], max(want[-1][1], b))
            else:
                want.append((a, b))
        assert got[n] == want


def test_rounding(one):
    assert one(M.round2(F.col("c")), c=1.005) == 1.0 and one(M.rounded(F.col("c")), c=-2.5) == -2.0 and one(M.round1(F.col("c")), c=2.25) == 2.3


def test_provider_figures(one):
    assert one(M.minutes_to_timestamp(F.col("c")), c=0).isoformat() == "2011-01-01T00:00:00"
    assert one(M.timestamp_to_minutes(M.minutes_to_timestamp(F.col("c"))), c=7654321) == 7654321
    assert [one(M.dollars(F.col("c")), c=v) for v in (41999, 4900, -1)] == [419.99, 49.0, None]
    assert one(M.pairs(F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 4, 5)]))) == [(1, 2), (3, 4)]
    assert one(M.pairs(F.lit(None).cast("array<bigint>"))) == []
    stats = F.array(F.lit(None).cast("double"), F.lit(429.99))
    assert one(M.current_price(stats)) == 429.99
    assert one(M.stat_dollars(F.lit(None).cast("long"), F.array(F.lit(12345), F.lit(41999)))) == 419.99


def test_verdicts(one):
    state = lambda c, a: one(M.buy_state(F.lit(c), F.lit(a).cast("double")))
    assert [state(101.0, 100.0), state(95.0, 100.0), state(102.0, 100.0), state(1.0, None)] == ["typical", "good", "elevated", None]
    assert one(M.verdict(F.lit(95.0), F.lit(100.0), F.lit(60.0))) == "inflated"
    assert [one(M.pulse_class(F.lit(v))) for v in (-1.0, 0.0, 9.9, 10.0)] == ["down", "neutral", "neutral", "up"]
    assert [one(M.alert_prefill(F.lit(v))) for v in (100.0, 1.0)] == [90, 1]
    assert one(M.value_word(F.lit(10.0), F.lit(0), F.lit(1.0))) is None
    assert [one(M.money(F.lit(v))) for v in (1234.5, -2.0)] == ["$1,234.50", "-$2.00"] and one(M.per_gb(F.lit(0.5))) == "$0.500/GB"


def test_times(one):
    at = lambda t: one(F.date_format(M.next_fetch(F.lit(t).cast("timestamp")), "dd HH:mm"))
    assert [at("2024-01-01 05:59:00"), at("2024-01-01 06:00:00"), at("2024-01-01 18:00:00")] == ["01 06:00", "01 18:00", "02 06:00"]
    ago = lambda t: one(M.relative_time(F.lit(t).cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp")))
    assert [ago("2024-01-02 00:01:00"), ago("2024-01-01 23:30:00"), ago("2024-01-01 23:00:00"), ago("2023-12-31 00:00:00")] == ["just now", "30 minutes ago", "1 hour ago", "2 days ago"]


def test_validation(one):
    errors = lambda e, p, i="x": one(X.alert_errors(F.lit(e), F.lit(p), F.lit(i)))
    assert errors(" A@B.co ", "1") == [] and errors("a@b.co", "10000") == [] and errors("a@b.co", "0.99") == ["price_too_low"] and errors("a@b.co", "10000.01") == ["price_too_high"]
    assert errors("a", "x", " ") == ["email_invalid", "price_not_a_number", "product_missing"] and errors("", "", "") == ["email_missing", "price_missing", "product_missing"]
    assert one(X.sanitized_alert(F.lit(" A@B.co "), F.lit("5"), F.lit(" p ")))["email"] == "a@b.co"


def test_links(one):
    assert one(X.with_tag(F.col("c"), "t-20"), c="https://x/y?z=1") == "https://x/y?z=1&tag=t-20" and one(X.with_tag(F.col("c"), "t"), c="") == "#"
    link = one(X.deep_link(F.col("c"), F.lit("xc/Oes*5"), "44583", "https://click.test/deeplink"), c="https://shop.test/p?a=1&b=2")
    assert link == "https://click.test/deeplink?id=xc/Oes*5&mid=44583&murl=https%3A%2F%2Fshop.test%2Fp%3Fa%3D1%26b%3D2"
    with pytest.raises(Exception, match="absolute"):
        one(X.deep_link(F.col("c"), F.lit("i"), "1", "b"), c="shop")
    with pytest.raises(Exception, match="missing"):
        one(X.deep_link(F.col("c"), F.lit(""), "1", "b"), c="https://x")


def test_content_hash(one):
    a, b = 'x?v=1 Last updated: now< "validFrom": "1"', 'x?v=22 Last updated: then< "validFrom": "2"'
    assert one(X.content_hash(F.col("c")), c=a) == one(X.content_hash(F.col("c")), c=b) != one(X.content_hash(F.col("c")), c="y")


def test_part_numbers_in_any_bracket_are_whole(one):
    assert one(X.part_number(F.col("c")), c="RAM 8GB (2x8GB) (CMK1001561)") == "CMK1001561"
    assert one(X.part_number(F.col("c")), c="RAM (CMK000010 ) 8GB") == "CMK000010"


def test_feed_numbers_past_six_digits(spark, tmp_path):
    """Parts of a million and more keep their own numbers: none meets the part whose number begins like its own."""
    import duckdb

    from pricegrain.plans import entities

    ids = (122222, 1222222, 1222223, 100156, 1001561, 1001560, 1001564)
    rows = [(i, "plate", "Brand#6", "T", 16, 100.0) for i in ids]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entities.part_number_match(spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(entities.SQL["part_number_match"]).fetchall()) and len(got) >= 2


def test_fixed_places_are_those_of_printf(spark):
    """Exact halves go to even, what lies just beside a half does not count as one."""
    import random

    draw = random.Random(2)
    values = [0.125, 0.375, -0.25, 14.125, 0.8125, 0.8135, 1.005, 2.675, 0.9995, 0.99951, 9.9999, -0.04, -0.0, 0.0, 1e-300, 123456789012.345, 2.0**52 + 0.5, 1e15 / 7]
    values += [draw.uniform(-5, 5) for _ in range(3000)] + [draw.randrange(10**7) / 2000 for _ in range(3000)] + [draw.randrange(10**6) / 2**draw.randrange(12) for _ in range(3000)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for r in d.select("v", *[M.fixed(F.col("v"), n).alias(str(n)) for n in (1, 2, 3)]).collect():
        assert [r[str(n)] for n in (1, 2, 3)] == [f"{r['v']:.{n}f}" for n in (1, 2, 3)]


def test_texts_and_minutes_give_the_rows_of_their_sql(spark, tmp_path):
    """Prices whose figures lie beside a half, and events in the last half millisecond of a minute and before 1970."""
    from datetime import datetime

    import duckdb

    from pricegrain.plans import titles

    parts = [(k, "n", "b", "t", size, price) for k, (size, price) in enumerate([(3, 90.9), (5, 1200.25), (7, 1199.75), (1, 46.625), (31, 939.45), (9, 1200.0), (2, 37.3 * 2)] + [(k % 50 + 1, 900 + k * 7.37) for k in range(2000)])]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    at = [datetime(2024, 1, 1, 0, 0, 59, us) for us in (999_499, 999_500, 999_600, 999_999, 0)] + [datetime(1969, 12, 31, 23, 59, 59, us) for us in (999_499, 999_500, 999_501)]
    spark.createDataFrame(list(enumerate(at)), "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    for table in ("part", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("price_texts", "provider_minutes"):
        got = sorted(tuple(r) for r in titles.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.execute(titles.SQL[name]).fetchall())
