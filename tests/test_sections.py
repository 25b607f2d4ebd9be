"""The part of a page that tells of a product, with nested and broken markup."""

from pyspark.sql import functions as F

from lodestone.functions import sections as s


def test_lists_tables_and_windows():
    spec = "<td>RTX-4060</td><td>Memory 8 GB, clock 2460 MHz</td>"
    assert s.section_of(f'<table><tr>{spec}</table><div ID="x" id="specs-list"><p>CPU <b>i5</b></div><p>after', ["rtx-4060"]) == "CPU i5"
    assert s.section_of(f"<p>intro<table><tr><td>rtx-4060ti 8 GB GB GB</table><table>{spec}</table>", ["RTX-4060"]) == "RTX-4060 Memory 8 GB, clock 2460 MHz"
    nested = f"<table><tr><td>Shop news about everything and more of it, as long as it takes<table><tr>{spec}</table></td></tr></table>"
    assert s.section_of(nested, ["rtx-4060"]) == "RTX-4060 Memory 8 GB, clock 2460 MHz"
    assert s.section_of(f"<nav>menu</nav><p>x<table><tr>{spec}", ["rtx-4060"]).startswith("RTX-4060 Memory")  # never closed
    assert s.section_of("</table></p><table><td>rtx-4060 is fine</td></table> text</div> end", ["rtx-4060"]) == "rtx-4060 is fine text end"  # too few signals
    assert s.section_of("<script>var a = '<table>rtx GB GB</table>'</script><style>p{}</style><p>Sólo TEXTO &amp; más", ["rtx"]) == "Sólo TEXTO & más"
    assert s.section_of("<header><table>rtx GB</table></header>", ["rtx"]) == "" == s.section_of("", [])
    far = "a" * 20000 + " Núcleo " + "b" * 20000
    window = s.section_of(f"<p>{far}", ["nucleo"])
    assert len(window) == 2 * s.REACH and "Núcleo" in window and s.section_of(f"<p>{far}", ["none"]) == far[: s.MOST]
    large = "<table>" + "<tr><td>rtx-4060 GB MHz</td></tr>" * 600 + "</table>"
    assert s.section_of(large + f"<table>{spec}</table>", ["rtx-4060"]).startswith("RTX-4060 Memory") and len(s.section_of(large, ["rtx-4060"])) > s.TABLE_CHARACTERS


def test_section_over_pages(spark):
    """Whole pages with a nested table spliced in: the inner one is found in each, and pages without needles give their text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    table = F.concat(F.lit("<table><tr><td>shop<table><tr><td>PX-"), "page_id", F.lit("</td><td>16 GB DDR5 memory, core clock 4 GHz</td></tr></table></table>"))
    spliced = pages.withColumn("html", F.regexp_replace("html", F.lit("(<body[^>]*>)"), F.concat(F.lit("$1"), table)))
    got = spliced.select("page_id", s.section("html", F.array(F.concat(F.lit("px-"), "page_id"))).alias("part")).collect()
    assert len(got) == pages.count() and all(r["part"] == f"PX-{r['page_id']} 16 GB DDR5 memory, core clock 4 GHz" for r in got)
    odd = spark.createDataFrame([(None, ["a"]), ("<p>x", None), ("", [])], "html string, needles array<string>")
    assert [r[0] for r in odd.select(s.section("html", "needles")).collect()] == [None, "x", ""]
