from weir.sources.csv import read_csv, write_csv
from weir.sources.dataset import Datasets, publish_checked
from weir.sources.generator import generate, generate_for
from weir.sources.jdbc import incremental, next_watermark, read_jdbc, write_jdbc
from weir.sources.json import read_json, read_ndjson, write_ndjson
from weir.sources.objects import read_object, render, write_object
from weir.sources.pages import landed_records

__all__ = [
    "Datasets", "generate", "generate_for", "incremental", "landed_records", "next_watermark", "publish_checked", "read_csv",
    "read_jdbc", "read_json", "read_ndjson", "read_object", "render", "write_csv", "write_jdbc", "write_ndjson", "write_object",
]
