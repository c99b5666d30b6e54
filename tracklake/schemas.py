"""Table schemas (DDL). Ids are BIGINT holding unsigned 32-bit values; every table may carry a ``dataset`` column."""

MAX_U32 = 4294967295
#: largest id a float32 shader can tell apart
MAX_LABEL_ID = 16777215

CELLS = (
    "id BIGINT, t BIGINT, z DOUBLE, y DOUBLE, x DOUBLE, area BIGINT, detection_confidence DOUBLE, state STRING, track_id BIGINT, src_id BIGINT, seg_id BIGINT, "
    "labels ARRAY<STRING>, track_labels ARRAY<STRING>, features STRING, reviewed BOOLEAN"
)
LINKS = "parent BIGINT, child BIGINT, confidence DOUBLE, reviewed BOOLEAN"
MASK_LABELS = "t BIGINT, label BIGINT"
MASK_EXTENT = "t BIGINT, label BIGINT, z0 BIGINT, z1 BIGINT, y0 BIGINT, y1 BIGINT, x0 BIGINT, x1 BIGINT, area BIGINT, sum_z DOUBLE, sum_y DOUBLE, sum_x DOUBLE"
RUNS = "t BIGINT, z BIGINT, y BIGINT, x0 BIGINT, x1 BIGINT, label BIGINT"
CHUNKS = "layer STRING, level INT, t BIGINT, c BIGINT, gz BIGINT, gy BIGINT, gx BIGINT, oz BIGINT, oy BIGINT, ox BIGINT, nz BIGINT, ny BIGINT, nx BIGINT, dtype STRING, data BINARY"
EDITS = "seq BIGINT, ts TIMESTAMP, domain STRING, op STRING, inverse STRING, undone BOOLEAN, pending BOOLEAN"
EDIT_BLOBS = "seq BIGINT, chunk_key STRING, existed BOOLEAN, before BINARY"
#: one cell of a tracking document; features are a JSON object of any values
RECORD = (
    "id BIGINT, t BIGINT, seg_id BIGINT, track_id BIGINT, centroid ARRAY<DOUBLE>, children ARRAY<STRUCT<id: BIGINT, confidence: DOUBLE>>, parent STRUCT<id: BIGINT, confidence: DOUBLE>, "
    "confidence DOUBLE, state STRING, labels ARRAY<STRING>, track_labels ARRAY<STRING>, features VARIANT"
)
