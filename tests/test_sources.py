import io
import zipfile

from sparkveil.cli import main, parser, process
from sparkveil.config import Options, config_hash
from sparkveil.sources.documents import docx_text, read_folder
from sparkveil.sources.sinks import write_run
from sparkveil.streaming.stream import write_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx() -> bytes:
    body = "<w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"Mail a@b.com\r\nbad \xff byte")
    (tmp_path / "in/sub/b.DOCX").write_bytes(docx())
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    (tmp_path / "in/d.md").write_text("ignored")
    return str(tmp_path / "in")


def test_folder(spark, tmp_path):
    assert docx_text(docx()) == "Hello\na | b"
    rows = {r.source_file: r for r in read_folder(spark, folder(tmp_path)).collect()}
    assert sorted(rows) == ["a.txt", "b.DOCX", "c.docx"]
    assert rows["a.txt"].text == "Mail a@b.com\nbad � byte" and rows["a.txt"].quality == 1.0
    assert rows["b.DOCX"].text == "Hello\na | b" and rows["c.docx"].error


def test_run_and_sinks(spark, tmp_path):
    results = process(read_folder(spark, folder(tmp_path)), Options())
    row = write_run(results, str(tmp_path / "out"), per_document_texts=True).first()
    assert (row.documents_total, row.documents_failed) == (3, 1)
    assert row.by_entity_type_total == {"EMAIL": 1} and row.finished_at >= row.started_at and row.duration_seconds >= 0
    assert next((tmp_path / "out/documents/anonymised/document=a").glob("part-*")).read_text() == "Mail [EMAIL_1]\nbad \ufffd byte\n"
    assert spark.read.parquet(str(tmp_path / "out/token_map")).first().value == "a@b.com"
    assert spark.read.json(str(tmp_path / "out/failures")).first().stage == "extraction"


def test_cli_bad_input(tmp_path):
    assert main(["--input", str(tmp_path / "none"), "--output", str(tmp_path)]) == 2


def test_cli_defaults():
    args = parser().parse_args([])
    assert (args.input, args.output, args.ollama_model, args.llm_verify, args.quiet) == ("./input", "./output", "llama3.1:8b", False, False)
    assert parser().parse_args(["--llm-verify", "--no-llm-verify", "--quiet"]).llm_verify is False and 1 <= args.workers <= 4


def test_config(tmp_path):
    assert config_hash(None) == "00000000" and Options.load(None) == Options()
    (tmp_path / "c.yaml").write_text("options:\n  normalise: never\n")
    assert Options.load(str(tmp_path / "c.yaml")).normalise == "never"


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", "to a@b.com")], "doc_key string, text string").write.parquet(str(tmp_path / "s"))
    docs = spark.readStream.schema("doc_key string, text string").parquet(str(tmp_path / "s"))
    write_stream(docs, str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).first().anonymised_text == "to [EMAIL_1]"
