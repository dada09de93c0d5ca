"""Text sources of shapes, labels, features and graphs. A file is one row of whole text, so line numbers survive; shape_id is the
file's name without folder and extension. Everything but the fan of polygons is column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def path_parts(path: Column) -> Column:
    """struct(dir, base, ext, name) of a path."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.struct(F.regexp_replace(path, r"[/\\]?[^/\\]*$", "").alias("dir"), base.alias("base"), F.regexp_extract(base, r"\.([^.]*)$", 1).alias("ext"), F.regexp_replace(base, r"\.[^.]*$", "").alias("name"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, path, text of each file under a path or pattern; files that `sinks.write_texts` wrote bear their folder's shape_id."""
    at = F.col("_metadata.file_path")
    named = F.regexp_extract(at, r"/shape_id=([^/]*)/[^/]*$", 1)
    return spark.read.text(path, wholetext=True).select(F.when(named != "", named).otherwise(stem(at)).alias("shape_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, *, blank: bool = False) -> DataFrame:
    """shape_id, n (from 0, of the lines kept), line (trimmed)."""
    all_lines = F.transform(F.split(F.regexp_replace("text", r"\r", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\t", " ")))
    kept = all_lines if blank else F.filter(all_lines, lambda x: x != "")
    return files(spark, path).select("shape_id", F.posexplode(kept).alias("n", "line"))


def tokens(rows: DataFrame) -> DataFrame:
    """Adds t: the line split at runs of spaces."""
    return rows.withColumn("t", F.split("line", " +"))


def number(t: str | Column, k: int, kind: str = "double") -> Column:
    """The k-th token as a number, null if there is none or it is none."""
    c = F.get(F.col(t) if isinstance(t, str) else t, F.lit(k))
    return c.try_cast("float").cast("double") if kind == "float" else c.try_cast(kind)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """path: the non-blank lines of a list file."""
    return lines(spark, path).select(F.col("line").alias("path"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files under a folder, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """name, is_folder, files, bytes of what lies in a folder: its files, and its sub-folders with all files below them.

    Nothing is read but the listing. A folder without any file below it has no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    base = F.regexp_replace(F.lit(folder), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?|/+$", "")
    below = F.regexp_replace(F.col("path"), "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    rest = F.expr("substring(below, length(base) + 2)")
    named = found.withColumns({"base": base, "below": below}).withColumn("rest", rest)
    named = named.select(F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("inner"), "length")
    return named.groupBy("name").agg(F.bool_or("inner").alias("is_folder"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """.pts: fewer than four tokens are x y z, more are face, centroid and x y z. Coordinates are of single precision."""
    rows = tokens(lines(spark, path))
    short = F.size("t") < 4
    xyz = [F.when(short, number("t", k, "float")).otherwise(number("t", k + 4, "float")).alias(c) for k, c in enumerate("xyz")]
    more = [F.when(~short, number("t", k + 1, "float")).alias(c) for k, c in enumerate(("bx", "by", "bz"))]
    return rows.select("shape_id", F.col("n").alias("point_idx"), *xyz, F.when(~short, number("t", 0, "int")).alias("face_idx"), *more)


def _off(spark: SparkSession, path: str) -> DataFrame:
    """Lines of .off files without comments and the keyword line, with nv and nf from the counts line."""
    rows = lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).filter("line <> ''")
    rows = rows.filter(~F.upper("line").rlike("^[A-Z]*OFF$"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("shape_id").orderBy("n")) - 2)  # counts line: -1
    rows = tokens(rows)
    head = rows.filter("n = -1").select("shape_id", number("t", 0, "int").alias("nv"), number("t", 1, "int").alias("nf"))
    return rows.filter("n >= 0").join(head, "shape_id")


def read_off_vertices(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, v_idx, x, y, z and the normal nx, ny, nz where a line holds one."""
    v = _off(spark, path).filter("n < nv")
    return v.select("shape_id", F.col("n").alias("v_idx"), *(number("t", k).alias(c) for k, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))))


def read_off_polygons(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, f_idx, corners."""
    face = F.expr("n >= nv and n < nv + nf")
    f = _off(spark, path).filter(face)
    # the condition again, as a check of the corners may be evaluated before the filter
    corners = F.when(face, F.transform(F.slice("t", 2, number("t", 0, "int")), lambda x: x.try_cast("int")))
    return f.select("shape_id", (F.col("n") - F.col("nv")).alias("f_idx"), corners.alias("corners"))


def triangles(polygons: DataFrame) -> DataFrame:
    """Triangle faces of a table whose polygons are all triangles; any other polygon is an error."""
    ok = F.assert_true(F.col("corners").isNull() | (F.size("corners") == 3), F.lit("a face is no triangle"))
    return polygons.select("shape_id", "f_idx", F.coalesce(ok.cast("int"), F.get("corners", F.lit(0))).alias("v0"), F.get("corners", F.lit(1)).alias("v1"), F.get("corners", F.lit(2)).alias("v2"))


def fan(polygons: DataFrame) -> DataFrame:
    """shape_id, f_idx (renumbered), v0, v1, v2: polygons cut into triangles from their first corners."""
    cut = F.transform(F.sequence(F.lit(1), F.size("corners") - 2), lambda k: F.struct(F.get("corners", F.lit(0)).alias("v0"), F.get("corners", k).alias("v1"), F.get("corners", k + 1).alias("v2")))
    rows = polygons.filter(F.size("corners") >= 3).select("shape_id", "f_idx", F.posexplode(cut).alias("k", "c"))
    order = W.partitionBy("shape_id").orderBy("f_idx", "k")
    return rows.select("shape_id", (F.row_number().over(order) - 1).alias("f_idx"), "c.v0", "c.v1", "c.v2")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices, and polygons with corners, texture and normal indices (from 0; null where a corner has none)."""
    rows = tokens(lines(spark, path))
    v = rows.filter(F.get("t", F.lit(0)) == "v")
    vertices = v.select("shape_id", (F.row_number().over(W.partitionBy("shape_id").orderBy("n")) - 1).alias("v_idx"), *(number("t", k + 1).alias(c) for k, c in enumerate("xyz")))
    order = W.partitionBy("shape_id").orderBy("n")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = rows.withColumns({f"n_{k}": F.count(F.when(F.get("t", F.lit(0)) == k, 1)).over(upto) for k in ("v", "vt", "vn")})
    f = counted.filter(F.get("t", F.lit(0)) == "f")
    corner = F.slice("t", 2, F.size("t") - 1)

    def index(part: int, have: str) -> Column:
        def one(c: Column) -> Column:
            i = F.get(F.split(c, "/"), F.lit(part)).try_cast("int")
            return F.when(i < 0, F.col(have).cast("int") + i).otherwise(i - 1)

        return F.transform(corner, one)

    polygons = f.select("shape_id", (F.row_number().over(order) - 1).alias("f_idx"), index(0, "n_v").alias("corners"), index(1, "n_vt").alias("textures"), index(2, "n_vn").alias("normals"))
    return vertices, polygons


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and polygons of ASCII .ply files whose vertices start with x y z."""
    rows = tokens(lines(spark, path))
    at = rows.groupBy("shape_id").agg(
        F.min(F.when(F.col("line") == "end_header", F.col("n"))).alias("head"),
        F.max(F.when(F.col("line").startswith("element vertex"), number("t", 2, "int"))).alias("nv"),
        F.coalesce(F.max(F.when(F.col("line").startswith("element face"), number("t", 2, "int"))), F.lit(0)).alias("nf"),
    )
    body = rows.join(at, "shape_id").withColumn("k", F.col("n") - F.col("head") - 1).filter("k >= 0")
    vertices = body.filter("k < nv").select("shape_id", F.col("k").alias("v_idx"), *(number("t", i).alias(c) for i, c in enumerate("xyz")))
    polygons = body.filter("k >= nv and k < nv + nf").select("shape_id", (F.col("k") - F.col("nv")).alias("f_idx"), F.transform(F.slice("t", 2, number("t", 0, "int")), lambda x: x.try_cast("int")).alias("corners"))
    return vertices, polygons


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, f_idx, corner, x, y, z of ASCII .stl files."""
    v = tokens(lines(spark, path)).filter(F.get("t", F.lit(0)) == "vertex")
    k = F.row_number().over(W.partitionBy("shape_id").orderBy("n")) - 1
    return v.select("shape_id", F.floor(k / 3).cast("int").alias("f_idx"), (k % 3).alias("corner"), *(number("t", i + 1).alias(c) for i, c in enumerate("xyz")))


def read_matrix(spark: SparkSession, path: str, *, separator: str = " +") -> DataFrame:
    """shape_id, i, row: numbers of each line; rows of different sizes are an error."""
    rows = lines(spark, path).select("shape_id", F.col("n").alias("i"), F.transform(F.split("line", separator), lambda x: x.try_cast("double")).alias("row"))
    width = rows.groupBy("shape_id").agg(F.min(F.size("row")).alias("a"), F.max(F.size("row")).alias("b"))
    ok = F.assert_true(F.col("a") == F.col("b"), F.lit("rows of different sizes")).isNull()
    return rows.join(width.filter(ok), "shape_id").select("shape_id", "i", "row")


def read_dmat(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, i, j, v of ASCII .dmat files: columns and rows in the first line, then the values by columns."""
    rows = tokens(lines(spark, path))
    head = rows.filter("n = 0").select("shape_id", number("t", 1, "int").alias("rows"))
    v = rows.filter("n > 0").join(head, "shape_id")
    k = F.row_number().over(W.partitionBy("shape_id").orderBy("n")) - 1
    return v.select("shape_id", (k % F.col("rows")).alias("i"), F.floor(k / F.col("rows")).cast("int").alias("j"), number("t", 0).alias("v"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges (from 0) of .tgf files."""
    rows = tokens(lines(spark, path))
    mark = rows.filter(F.col("line").startswith("#")).groupBy("shape_id").agg(F.min("n").alias("mark"))
    rows = rows.join(mark, "shape_id").filter(~F.col("line").startswith("#"))
    v = rows.filter("n < mark").select("shape_id", (number("t", 0, "int") - 1).alias("v_idx"), *(number("t", k + 1).alias(c) for k, c in enumerate("xyz")))
    e = rows.filter("n > mark").select("shape_id", (number("t", 0, "int") - 1).alias("i"), (number("t", 1, "int") - 1).alias("j"))
    return v, e


def read_tets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, triangles and tets (all from 0) of .mesh files: a section's name, its number of lines, and these; references are left out."""
    rows = tokens(lines(spark, path))
    heads = rows.filter(F.col("line").isin("Vertices", "Triangles", "Tetrahedra")).select("shape_id", F.col("n").alias("at"), F.col("line").alias("section"))
    sizes = rows.select("shape_id", (F.col("n") - 1).alias("at"), number("t", 0, "int").alias("size"))
    heads = heads.join(sizes, ["shape_id", "at"])  # a few rows a file
    met = rows.join(heads, "shape_id").filter("n > at + 1 and n <= at + 1 + size").select("shape_id", "section", (F.col("n") - F.col("at") - 2).alias("k"), "t")
    corners = lambda section, index, m: met.filter(F.col("section") == section).select("shape_id", F.col("k").alias(index), *((number("t", i, "int") - 1).alias(f"v{i}") for i in range(m)))
    vertices = met.filter(F.col("section") == "Vertices").select("shape_id", F.col("k").alias("v_idx"), *(number("t", i).alias(c) for i, c in enumerate("xyz")))
    return vertices, corners("Triangles", "f_idx", 3), corners("Tetrahedra", "t_idx", 4)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """.seg: shape_id, elem_idx, label, an integer a line, of any number of digits."""
    return lines(spark, path).select("shape_id", F.col("n").alias("elem_idx"), F.col("line").try_cast("int").alias("label"))


def label_path(path: Column, folder: str = "") -> Column:
    """Where a shape's labels lie: in `folder`, or, if that is empty, `gt` beside the folder of the shape."""
    name = F.concat(stem(path), F.lit(".seg"))
    beside = F.regexp_replace(path, r"[/\\][^/\\]*[/\\][^/\\]*$", "/gt/")
    return F.concat(F.lit(folder.rstrip("/") + "/") if folder else beside, name)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, point_idx, f of headerless comma-separated files."""
    return read_matrix(spark, path, separator=" *, *").select("shape_id", F.col("i").alias("point_idx"), F.col("row").alias("f"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """label, name: a line `name pnts 1` each, up to the first blank one; another form is an error."""
    rows = lines(spark, path, blank=True)
    end = F.coalesce(F.min(F.when(F.col("line") == "", F.col("n"))).over(W.partitionBy("shape_id")), F.lit(2**31 - 1))
    rows = tokens(rows.withColumn("end", end).filter("n < end"))
    ok = F.assert_true((F.size("t") == 3) & (F.get("t", F.lit(1)) == "pnts") & (F.get("t", F.lit(2)) == "1"), F.lit("a region line is not `name pnts 1`"))
    return rows.select(F.coalesce(ok.cast("int"), F.col("n")).alias("label"), F.get("t", F.lit(0)).alias("name"))


def read_symmetry(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """group_idx, members: names of a line as labels; an unknown name is the null label, the number of regions."""
    n = regions.count()
    names = lines(spark, path).select(F.col("n").alias("group_idx"), F.posexplode(F.split("line", " +")).alias("k", "name"))
    met = names.join(F.broadcast(regions), "name", "left").withColumn("label", F.coalesce("label", F.lit(n)))
    return met.groupBy("group_idx").agg(F.sort_array(F.collect_list(F.struct("k", "label"))).alias("m")).select("group_idx", F.col("m.label").alias("members"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, elem_idx, value: a number a line."""
    return lines(spark, path).select("shape_id", F.col("n").alias("elem_idx"), F.col("line").try_cast("double").alias("value"))


def read_feature_vertices(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, v_idx, note of lines `vertex, note`; negative vertices are left out."""
    rows = lines(spark, path).select("shape_id", F.regexp_extract("line", r"^(-?\d+) *,", 1).try_cast("int").alias("v_idx"), F.trim(F.regexp_extract("line", r"^-?\d+ *,(.*)$", 1)).alias("note"))
    return rows.filter("v_idx >= 0")


def read_face_labels(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, elem_idx, label; faces with a negative label have none, but count."""
    return read_labels(spark, path).filter("label >= 0")


def read_grouped_face_labels(spark: SparkSession, path: str) -> DataFrame:
    """shape_id, elem_idx (from 0), label of files that alternate a label and the faces (from 1) that have it."""
    rows = lines(spark, path).withColumns({"pair": F.floor(F.col("n") / 2), "odd": F.col("n") % 2})
    both = rows.groupBy("shape_id", "pair").agg(F.max(F.when(F.col("odd") == 0, F.col("line"))).try_cast("int").alias("label"), F.max(F.when(F.col("odd") == 1, F.col("line"))).alias("faces"))
    return both.select("shape_id", F.explode(F.split("faces", " +")).alias("f"), "label").select("shape_id", (F.col("f").try_cast("int") - 1).alias("elem_idx"), "label")


def read_first_features(spark: SparkSession, path: str) -> DataFrame:
    """The first line of each feature file."""
    return read_features(spark, path).filter("point_idx = 0")
