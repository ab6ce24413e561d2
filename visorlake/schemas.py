"""Declared schemas of the tables the operators exchange."""
from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, INT, LONG, DBL, FLT, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.FloatType(), T.BooleanType())

POINT = _s(("x", DBL), ("y", DBL))
KEYPOINT = _s(("x", DBL), ("y", DBL), ("v", INT))
RECT = _s(("x1", DBL), ("y1", DBL), ("x2", DBL), ("y2", DBL), ("conf", DBL))

SAMPLES = _s(("sample_id", STR), ("path", STR), ("source", STR), ("split", STR),
             ("width", INT), ("height", INT))
BOXES = _s(("sample_id", STR), ("box_no", INT), ("cls", INT), ("cx", DBL), ("cy", DBL),
           ("w", DBL), ("h", DBL), ("conf", DBL))
KEYPOINT_BOXES = T.StructType(BOXES.fields + [T.StructField("keypoints", T.ArrayType(KEYPOINT))])
POLYGONS = _s(("sample_id", STR), ("poly_no", INT), ("cls", INT), ("points", T.ArrayType(POINT)))
ANNOTATION_MAP = T.MapType(STR, _s(
    ("bboxes", T.ArrayType(T.ArrayType(DBL))),
    ("hand_landmarks", T.ArrayType(T.ArrayType(T.ArrayType(DBL)))),
    ("user_id", STR)))
FRAMES = _s(("video_id", STR), ("frame_idx", INT), ("fps", DBL), ("balls", T.ArrayType(RECT)),
            ("clubs", T.ArrayType(RECT)), ("holes", T.ArrayType(RECT)), ("cam", T.ArrayType(DBL)))
DETECTIONS = _s(("video_id", STR), ("frame_idx", INT), ("cls", INT), ("x1", DBL), ("y1", DBL),
                ("x2", DBL), ("y2", DBL), ("conf", DBL))
HASHES = _s(("sample_id", STR), ("hash", LONG))
EMBEDDINGS = _s(("id", STR), ("key", STR), ("embedding", T.ArrayType(FLT)))
GALLERY = _s(("id", INT), ("label", STR), ("template", T.ArrayType(FLT)), ("count", INT))
TRACKS = _s(("video_id", STR), ("cls", INT), ("track_id", INT), ("frame_idx", INT),
            ("x1", DBL), ("y1", DBL), ("x2", DBL), ("y2", DBL), ("conf", DBL))
ANNOTATIONS = _s(("id", LONG), ("task_id", LONG), ("completed_by_id", LONG),
                 ("was_cancelled", INT), ("updated_at", T.TimestampType()))
USERS = _s(("id", LONG), ("first_name", STR), ("last_name", STR), ("email", STR))
PROJECTS = _s(("id", LONG), ("title", STR))
TASKS = _s(("id", LONG), ("project_id", LONG))
MANIFEST = _s(("person", STR), ("domains", STR), ("videos", INT), ("size_mb", DBL),
              ("minutes", DBL), ("split", STR))
LIVE = _s(("camera_id", STR), ("ts", T.TimestampType()), ("balls", T.ArrayType(RECT)),
          ("clubs", T.ArrayType(RECT)), ("dx", DBL), ("dy", DBL))


def require(df, schema: T.StructType):
    """Fail early when a table lacks a declared column."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
