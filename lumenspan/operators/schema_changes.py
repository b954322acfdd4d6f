"""Schema changes that diffs make, in SQL and in Python models.

Each line is read with what stands above it in the same file of the diff: the class and its kind,
and the table of an open CREATE. That context is carried by windows over the file, so no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenspan.functions import text as T
from lumenspan.operators.select import keep_first

# Column types, reserved words and base classes that name the kind of a model.
SQL_TYPES = (
    "INT|BIGINT|SMALLINT|TINYINT|INTEGER|SERIAL|BIGSERIAL|VARCHAR|NVARCHAR|CHAR|TEXT|CLOB|BOOLEAN|BOOL|FLOAT|DOUBLE|REAL|NUMERIC|DECIMAL|NUMBER|MONEY|"
    "DATE|DATETIME|TIMESTAMP|TIME|INTERVAL|JSON|JSONB|BLOB|BYTEA|BINARY|VARBINARY|UUID|OID|VARIANT|ARRAY|STRUCT|GEOGRAPHY|GEOMETRY"
)
NOT_COLUMNS = ("PRIMARY", "UNIQUE", "KEY", "INDEX", "CONSTRAINT", "CHECK", "FOREIGN", "REFERENCES", "DEFAULT", "NOT", "NULL", "AUTO_INCREMENT", "IDENTITY")
BASES = (
    ("pydantic", r"(^|,)\s*(BaseModel|BaseSettings|SQLModel|BaseSchema)\s*(,|$)"),
    ("typeddict", r"(^|,)\s*TypedDict\s*(,|$)"),
    ("django", r"models\.Model"),
    ("sqlalchemy", r"Base|Declarative(Base|Meta)|db\.Model|(^|,)\s*Model\s*(,|$)"),
)
ALTER = r"""(?i)ALTER\s+TABLE\s+[`"']?([\w.]+)[`"']?\s+(ADD|DROP|MODIFY|CHANGE|RENAME)\s+(?:COLUMN\s+)?[`"']?(\w+)[`"']?"""
CREATE = r"""(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TRANSIENT\s+|VOLATILE\s+|TEMP(?:ORARY)?\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"']?([\w.]+)[`"']?"""
DROP = r"""(?i)DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?[`"']?([\w.]+)[`"']?"""
SQL_COLUMN = rf"""(?i)^\s+[`"']?(\w+)[`"']?\s+({SQL_TYPES})\b"""
MIGRATION = r"""(?i)op\.(add_column|drop_column|alter_column|rename_table|create_table|drop_table)\s*\(\s*['"](\w+)['"](?:\s*,\s*(?:sa\.Column\s*\(\s*)?['"](\w+)['"])?(?:\s*,\s*(?:sa\.)?([\w()]+))?"""
MODEL_COLUMN = r"(?i)^\s+(\w+)\s*(?::\s*Mapped\[[\w\[\], |]+\])?\s*=\s*(?:mapped_column|Column)\s*\((.{0,80})\)"
RELATIONSHIP = r"""^\s+(\w+)\s*=\s*relationship\s*\(\s*['"](\w+)['"]"""
MODEL_FIELD = r"^\s{4}(\w+)\s*=\s*models\.(\w+Field|ForeignKey|ManyToManyField|OneToOneField|GenericForeignKey|GenericRelation)\s*\("
TYPED_FIELD = r"^\s{4}(\w+)\s*:\s*[\w\[\], |.]+"

CONSUMER_KINDS = (
    ("query", r"(?i)(SELECT|INSERT|UPDATE|DELETE|WHERE|JOIN|SET)\b"),
    ("orm", r"\.(filter|filter_by|order_by|group_by|annotate|values|only|defer)\s*\("),
    ("serializer", r"(Serializer|Schema|Validator|Form)\s*\("),
    ("handler", r"(request|response|payload|body|data)\["),
    ("test", r"(?i)(assert|expect|test_)"),
)


def consumer_kind(snippet: Column) -> Column:
    """How a line uses a name: the first kind that fits, empty if none does."""
    out = F.lit("")
    for name, pattern in reversed(CONSUMER_KINDS):
        out = F.when(snippet.rlike(pattern), name).otherwise(out)
    return out


def schema_changes(cursor: DataFrame, key: str = "pr_id") -> DataFrame:
    """``(key, file, line, kind, name, parent, change_type, col_type)``, each change of a file once.

    ``cursor`` is a diff's lines with ``change``, ``old_line``, ``new_line``, ``pos`` and ``text``.
    """
    text, path = F.col("text"), F.col("file")
    bare = T.strip(text)
    get = lambda pattern, n: F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))
    upto = Window.partitionBy(key, "file").orderBy("pos")
    ext = T.extension(path)
    in_py = ext == "py"
    statement = F.upper(bare).rlike(r"^(ALTER TABLE|CREATE TABLE|DROP TABLE|INSERT INTO|UPDATE |SELECT )")
    in_sql = ext.isin("sql", "ddl") | statement
    class_of = F.when(in_py & bare.rlike(r"^class\s+\w+"), F.regexp_extract(bare, r"^class\s+(\w+)", 1))
    bases = F.regexp_extract(bare, r"^class\s+\w+\s*\(([^)]*)\)", 1)
    kind_of = F.lit("")
    for name, pattern in reversed(BASES):
        kind_of = F.when(bases.rlike(pattern), name).otherwise(kind_of)
    decorated = F.lag(F.when(in_py & bare.rlike(r"^@(dataclasses?\.)?dataclass\b"), 1)).over(upto) == 1
    ends_class = in_py & class_of.isNull() & text.rlike(r"^[^\s@#)]")
    opened = F.when(class_of.isNotNull(), F.struct(class_of.alias("name"), F.when(F.coalesce(decorated, F.lit(False)), "dataclass").otherwise(kind_of).alias("kind"), F.col("pos").alias("at")))
    model = F.when(ends_class, F.struct(F.lit("").alias("name"), F.lit("").alias("kind"), F.col("pos").alias("at"))).otherwise(opened)
    create = F.when(in_sql & get(CREATE, 1).isNotNull(), get(CREATE, 1)).when(in_sql & bare.startswith(")"), F.lit(""))
    marked = cursor.select("*", F.last(model, True).over(upto).alias("model"), F.last(create, True).over(upto).alias("open_table"), in_sql.alias("in_sql"), in_py.alias("in_py"))
    marked = marked.withColumn("mapped", F.last(F.when(in_py, get(r"""__tablename__\s*=\s*['"](\w+)['"]""", 1)), True).over(Window.partitionBy(key, "file", "model.at").orderBy("pos")))
    line = F.coalesce("new_line", "old_line")
    none = F.lit(None).cast("string")

    def made(kind, name, parent, change, col_type=none):
        fields = {"kind": F.lit(kind), "name": name, "parent": parent, "change_type": change, "col_type": col_type}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    op, own, edited = F.lower(get(ALTER, 2)), F.col("change"), F.col("change") != "context"
    altered = F.when(op == "add", "added").when(op == "drop", "removed").when(op == "modify", "type_changed").otherwise("renamed")
    sql = (
        F.when(get(ALTER, 1).isNotNull(), made("sql_column", get(ALTER, 3), get(ALTER, 1), altered))
        .when(get(DROP, 1).isNotNull(), made("sql_table", get(DROP, 1), F.lit(""), F.lit("removed")))
        .when(get(CREATE, 1).isNotNull(), F.when(own == "added", made("sql_table", get(CREATE, 1), F.lit(""), F.lit("added"))))
        .when(
            (F.coalesce(F.col("open_table"), F.lit("")) != "") & get(SQL_COLUMN, 1).isNotNull() & ~F.upper(get(SQL_COLUMN, 1)).isin(*NOT_COLUMNS),
            made("sql_column", get(SQL_COLUMN, 1), F.col("open_table"), own, get(SQL_COLUMN, 2)),
        )
    )
    step = F.lower(get(MIGRATION, 1))
    migrated = F.when(step.isin("add_column", "create_table"), "added").when(step.isin("drop_column", "drop_table"), "removed").when(step == "rename_table", "renamed").otherwise("type_changed")
    migration = F.when(step.endswith("_column"), made("alembic_column", get(MIGRATION, 3), get(MIGRATION, 2), migrated, F.when(step == "add_column", get(MIGRATION, 4)))).when(
        step.isNotNull(), made("alembic_table", get(MIGRATION, 2), F.lit(""), migrated)
    )
    model_name, model_kind = F.col("model.name"), F.col("model.kind")
    typed = (get(TYPED_FIELD, 1).isNotNull()) & ~bare.rlike(r"^(#|def |class |model_config)")
    python = (
        F.when(path.rlike("(?i)migration|alembic|versions") & step.isNotNull(), migration)
        .when((model_kind == "sqlalchemy") & get(MODEL_COLUMN, 1).isNotNull(), made("sqlalchemy_column", get(MODEL_COLUMN, 1), F.coalesce("mapped", model_name), own, F.substring(get(MODEL_COLUMN, 2), 1, 60)))
        .when((model_kind == "sqlalchemy") & get(RELATIONSHIP, 1).isNotNull(), made("sqlalchemy_column", get(RELATIONSHIP, 1), model_name, own))
        .when((model_kind == "django") & get(MODEL_FIELD, 1).isNotNull(), made("django_field", get(MODEL_FIELD, 1), model_name, own, get(MODEL_FIELD, 2)))
        .when((model_kind == "pydantic") & typed, made("pydantic_field", get(TYPED_FIELD, 1), model_name, own))
        .when((model_kind == "typeddict") & typed, made("typeddict_field", get(TYPED_FIELD, 1), model_name, own))
        .when((model_kind == "dataclass") & typed, made("dataclass_field", get(TYPED_FIELD, 1), model_name, own))
    )
    found = marked.where(edited).withColumn("c", F.when(F.col("in_sql"), sql).when(F.col("in_py"), python)).where("c is not null")
    rows = found.select(key, "file", line.alias("line"), "pos", "c.kind", "c.name", "c.parent", "c.change_type", "c.col_type").where("name is not null")
    return keep_first(rows, [key, "file", "kind", "name", "parent", "change_type"], "pos").drop("pos")


def consumers(changes: DataFrame, lines: DataFrame, key: str = "pr_id") -> DataFrame:
    """``(key, name, file, line, snippet, consumer_kind)``: lines of other files with the changed name as a word.

    ``lines`` has ``path``, ``line`` and ``content``; names meet words by equality.
    """
    words = lines.select(F.col("path").alias("_path"), F.col("line").alias("_line"), "content", F.explode(F.array_distinct(F.split("content", r"(?U)\W+"))).alias("name"))
    names = changes.select(key, "name", F.col("file").alias("_defined")).distinct()
    hits = words.join(names, "name").where("_path <> _defined").dropDuplicates([key, "name", "_path", "_line"])
    snippet = F.substring(T.strip(F.col("content")), 1, 120)
    return hits.select(key, "name", F.col("_path").alias("file"), F.col("_line").alias("line"), snippet.alias("snippet"), consumer_kind(snippet).alias("consumer_kind"))


def consumers_by_object(consumers: DataFrame, key: str = "name", shown: int = 5) -> DataFrame:
    """``(object, refs, columns, more)`` of consumers of ``object.column`` names.

    The object is what stands before the last dot, "—" without one. ``refs`` counts the consumers,
    ``columns`` has the first ``shown`` distinct columns in order, ``more`` is the number of others.
    """
    name = F.col(key)
    dotted = name.contains(".")
    column = F.when(dotted, F.substring_index(name, ".", -1)).otherwise(name)
    object_ = F.when(dotted, F.regexp_replace(name, r"(?s)\.[^.]*\z", "")).otherwise("—")
    counts = consumers.groupBy(object_.alias("object"), column.alias("column")).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("object").orderBy("column")))
    first = F.array_compact(F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.col("column")))))
    return ranked.groupBy("object").agg(F.sum("n").alias("refs"), first.alias("columns"), F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))
