"""Diffs, code and job files that Spark makes of the suppliers: one set each, with names and contents by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenspan.functions.workers import spread
from lumenspan.operators import lines
from lumenspan.plans.shared import table

#: The same names in SQL: ``k`` the padded key, ``g`` its remainder by 7, ``o`` that by 2.
SQL = "WITH s AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS k, s_suppkey % 7 AS g, s_suppkey % 2 AS o FROM supplier)"

DIFF = """diff --git a/jobs/load_feature_{k}.py b/jobs/load_feature_{k}.py
index 1..2 100644
--- a/jobs/load_feature_{k}.py
+++ b/jobs/load_feature_{k}.py
@@ -1,4 +1,5 @@
 import pickle
-age_{k}: int = 0
-old_metric_{g}: float = 0.0
+age_{k}: float = 0.0
+new_score_{g}: float = 1.0
+{secret}
 df["total"]
@@ -20,2 +21,3 @@ def run():
     x = 1
+    data = pickle.loads(raw)
     return x
diff --git a/db/schema_{k}.sql b/db/schema_{k}.sql
--- a/db/schema_{k}.sql
+++ b/db/schema_{k}.sql
@@ -1,4 +1,6 @@
 CREATE TABLE users_{k} (
     id BIGINT,
-    name_{g} VARCHAR(10),
+    full_name_{g} VARCHAR(99),
+    born DATE,
 );
+ALTER TABLE orders_{g} DROP COLUMN note;
diff --git a/app/models_{k}.py b/app/models_{k}.py
new file mode 100644
--- /dev/null
+++ b/app/models_{k}.py
@@ -0,0 +1,6 @@
+class User_{k}(BaseModel):
+    email_{g}: str
+
+@dataclass
+class Point_{k}:
+    left: int
diff --git a/jobs/nightly_{k}.yml b/jobs/nightly_{k}.yml
--- a/jobs/nightly_{k}.yml
+++ b/jobs/nightly_{k}.yml
@@ -1,5 +1,7 @@
 name: nightly_{k}
-  quartz_cron_expression: "0 0 1 * * ?"
+  quartz_cron_expression: "0 0 {g} * * ?"
 tasks:
   - task_key: extract_{k}
-    num_workers: 2
+    num_workers: 4
+    fail_on_run_failure: false
+  - task_key: publish_{k}
"""

FILES = {
    "app/service_{k}.py": "def kept_{k}(a):\n    return a\n",
    "jobs/nightly_{k}.yml": """name: nightly_{k}
schedule:
  quartz_cron_expression: "0 0 {g} * * ?"
tasks:
  - task_key: extract_{k}
    notebook_path: "/jobs/extract"
    num_workers: 4
    fail_on_run_failure: false
  - task_key: publish_{k}
    depends_on:
      - task_key: extract_{k}
""",
    "jobs/report_{k}.yml": """name: report_{k}
tasks:
  - task_key: render_{k}
    depends_on:
      - task_key: publish_{k}
  - task_key: mail_{k}
    job_name: nightly_{k}
""",
    "etl/sales_{k}.sql": """CREATE OR REPLACE TABLE mart.sales_{g} AS
SELECT * FROM raw.orders_{k} o JOIN raw.customers c ON o.id = c.id;
DROP TABLE IF EXISTS old_sales_{k};
""",
    "models/core/report_{k}.sql": "-- a transform\nselect * from {{ ref('stg_{g}') }}\n",
    "ci/deploy_{k}.yml": "on_failure:\n  - ann@example.org\n",
    "lib/bad_{k}.py": "x = row.id.cast('int')\ntry:\n    run()\nexcept:\n    pass\n{secret}\n",
}
#: Files of the odd keys alone, and of those with a remainder of 3 by 7.
ODD = {"tests/test_service_{k}.py": "import pytest\n\n\ndef test_kept():\n    assert kept_{k}(1) == 1\n"}
THIRD = {"web/use_{k}.py": "from app import service_{k}\n", "checks/test_words_{k}.py": "# service_{k} is looked at elsewhere\n"}

BASE = """import os


def kept_{k}(a, b=1):
    return a + b


async def fetch(url: str) -> Optional[str]:
    return await get(url)


def old_{k}(x):
    return x * 2 + 40


class Store(Base):
    def save(self, row):
        return self.put(row)


def gone():
    pass
"""
HEAD = """import os


def kept_{k}(a, b=1):
    return a + b + {o}


@cached
def fetch(url: str, timeout: int) -> str:
    return get(url)


def new_{k}(x):
    return x * 2 + 40


class Store(Base):
    def save(self, row):
        return self.put(row)

    def load(self, key):
        return kept_{k}(key)
"""


def filled(template: str) -> Column:
    """A template with the names of a supplier."""
    number = F.col("s_suppkey")
    secret = F.when(number % 2 == 1, 'api_key = "abcdefgh12345678"').otherwise("limit = 3")
    out = F.lit(template)
    values = {"k": F.lpad(number.cast("string"), 6, "0"), "g": (number % 7).cast("string"), "o": (number % 2).cast("string"), "secret": secret}
    for name, value in values.items():
        if f"{{{name}}}" in template:
            out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey"))


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each supplier's diff."""
    diffs = suppliers(spark, sf_dir).select(filled("s{k}").alias("pr_id"), filled(DIFF).alias("diff"))
    return lines.diff_cursor(lines.diff_lines(diffs))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.changed_texts(cursor(spark, sf_dir))


def code(spark: SparkSession, sf_dir: str, *folders: str, ref: str = "head") -> DataFrame:
    """The files of each supplier, below the named folders; a repository each."""
    number = F.col("s_suppkey")
    listed = [*FILES.items(), *ODD.items(), *THIRD.items()]
    rows = []
    for n, (path, content) in enumerate(listed):
        if folders and not path.startswith(folders):
            continue
        there = number % 2 == 1 if path in ODD else number % 7 == 3 if path in THIRD else F.lit(True)
        rows.append(F.when(there, F.struct(F.lit(n).alias("n"), filled(path).alias("path"), filled(content).alias("content"))))
    some = suppliers(spark, sf_dir).select("s_suppkey", F.explode(F.array(*rows)).alias("f")).where("f is not null")
    order = (number * len(listed) + F.col("f.n")).cast("int")
    return some.select(filled("r{k}").alias("repo"), F.lit(ref).alias("ref"), order.alias("ord"), "f.path", "f.content", F.lit("blob").alias("type"))


def sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """A Python file of each supplier before and after a change."""
    return [
        suppliers(spark, sf_dir).select(filled("r{k}").alias("repo"), F.lit(ref).alias("ref"), filled("src/s_{k}.py").alias("path"), filled(text).alias("content"))
        for ref, text in (("base", BASE), ("head", HEAD))
    ]
