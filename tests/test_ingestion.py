from pyspark.sql import functions as F

from corpusloom.plans import ingestion


def test_ingest_decides_every_file(spark, tmp_path):
    body = "\n\n".join(f"Paragraph {i} about fees, rates and limits of the account number {i} in the book." for i in range(12))
    files = {
        "policy.md": "# Policy\n\n" + body + "\n\nMail a.b@x.org for more.",
        "policy copy.md": "# Policy\n\n" + body + "\n\nMail a.b@x.org for more.",
        "near.txt": "# Policy\n\n" + body.replace("limits of the account number 11", "limits of the account number 99") + "\n\nMail a.b@x.org for more.",
        "short.txt": "tbd",
        "empty.csv": "",
        "broken.docx": "not a zip",
        "stray.md": "# Who\n\nknows",
        "page.html": "<html><body><nav><p>menu menu</p></nav><h1>Cards</h1>" + "".join(f"<p>Card rule {i} says something new about spending limits abroad.</p>" for i in range(20)) + "</body></html>",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    catalog = spark.createDataFrame([(n, n.split(".")[0], "2025-01-01", "1") for n in files if n != "stray.md"], "filename string, doc_id string, effective_date string, version string")
    done = ingestion.ingest(spark, str(tmp_path), catalog)
    got = {r.filename: (r.status, r.stage) for r in done.documents.collect()}
    assert got == {
        "policy.md": ("cleaned", "clean"), "policy copy.md": ("dropped", "load"), "near.txt": ("dropped", "dedupe"), "short.txt": ("dropped", "clean"),
        "empty.csv": ("dropped", "load"), "broken.docx": ("quarantined", "parse"), "stray.md": ("quarantined", "load"), "page.html": ("cleaned", "clean"),
    }
    text = {r.filename: r.text for r in done.documents.collect()}
    assert "[REDACTED-EMAIL]" in text["policy.md"] and "menu" not in text["page.html"]
    assert ingestion.must_be_complete(done) == [] and {r.name for r in done.chunks.collect()} == {"policy", "page"}


def test_ingest_prefers_earlier_dates_and_redacts_names(spark, tmp_path):
    body = "\n\n".join(f"Paragraph {i} about fees, rates and limits of the account number {i} in the book." for i in range(12))
    (tmp_path / "a.md").write_text("# Policy\n\n" + body + "\n\nAsk Jane Doe or Harbor Bank.", encoding="utf-8")
    (tmp_path / "b.md").write_text("# Policy\n\n" + body + "\n\nAsk Jane Doe or the Harbor Bank.", encoding="utf-8")
    catalog = spark.createDataFrame([("a.md", "later", "2025-02-01", "1"), ("b.md", "earlier", "2024-12-01", "1")], "filename string, doc_id string, effective_date string, version string")

    def tag(blocks):
        span = lambda name: F.when(F.instr("text", name) > 0, F.struct((F.instr("text", name) - 1).alias("start"), (F.instr("text", name) - 1 + len(name)).alias("end")))
        return blocks.withColumn("name_spans", F.filter(F.array(span("Jane Doe"), span("Harbor Bank"), span("Ask")), lambda x: x.isNotNull()))

    done = ingestion.ingest(spark, str(tmp_path), catalog, tag_names=tag, not_names=["Bank"])
    got = {r.doc_id: (r.status, r.reason) for r in done.documents.collect()}
    assert got == {"earlier": ("cleaned", None), "later": ("dropped", "near-duplicate of earlier")}
    (last,) = [r for r in done.chunks.orderBy(F.desc("chunk_index")).limit(1).collect()]
    assert "Ask [REDACTED-NAME] or the Harbor Bank." in last.text and last.doc_id == "earlier" and last.page_start == -1
    assert {r.section_path for r in done.chunks.collect()} == {"Policy"}
