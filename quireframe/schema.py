"""Schemas of the engine's tables."""

RECT = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
SPAN = "STRUCT<text: STRING, size: DOUBLE, font: STRING, flags: INT>"
PAGES = f"doc_id BIGINT, page_no INT, rect {RECT}, rotation INT"
LINES = f"doc_id BIGINT, page_no INT, line_no INT, bbox {RECT}, spans ARRAY<{SPAN}>"
IMAGES = f"doc_id BIGINT, page_no INT, image_no INT, rect {RECT}"
DRAWINGS = f"doc_id BIGINT, page_no INT, drawing_no INT, rect {RECT}, fill ARRAY<DOUBLE>, color ARRAY<DOUBLE>"
TABLES = f"doc_id BIGINT, page_no INT, table_no INT, rect {RECT}, n_rows INT, n_cols INT"
CELLS = f"doc_id BIGINT, page_no INT, table_no INT, row_idx INT, col_idx INT, bbox {RECT}, text STRING"
FILE_STATE = "file_key STRING, status STRING, attempts INT, error STRING"
RESULTS = "ts TIMESTAMP, input STRING, output STRING, status STRING"
PAGE = ["doc_id", "page_no"]
