import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_pdf(pages: list[list[tuple[float, float, str]]], height: float = 800) -> bytes:
    """A plain PDF; each page is a list of (x, top, text)."""
    out = b"%PDF-1.4\n"
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    out += b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n" + f"2 0 obj <</Type /Pages /Kids [{kids}] /Count {len(pages)}>> endobj\n".encode()
    for i, page in enumerate(pages):
        body = b"".join(f"BT /F1 10 Tf 1 0 0 1 {x} {height - top} Tm (".encode() + text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET\n" for x, top, text in page)
        out += f"{10 + 2 * i} 0 obj <</Type /Page /Parent 2 0 R /MediaBox [0 0 600 {height}] /Contents {11 + 2 * i} 0 R>> endobj\n".encode()
        out += f"{11 + 2 * i} 0 obj <</Length {len(body)}>>\nstream\n".encode() + body + b"\nendstream endobj\n"
    return out
