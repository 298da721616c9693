"""Datasets of tenants: files in, Parquet by tenant and document out, temp views for SQL, a row of metadata for each."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning, ids
from ledgerspark.operators.membership import Membership
from ledgerspark.storage import deleted, folders

READERS = {
    "csv": lambda r, p: r.option("header", True).option("inferSchema", False).csv(p),
    "json": lambda r, p: r.option("multiLine", True).json(p),
    "jsonl": lambda r, p: r.json(p),
    "parquet": lambda r, p: r.parquet(p),
    "orc": lambda r, p: r.orc(p),
    "txt": lambda r, p: r.text(p),
}
#: Reading settings for stores that speak S3; off unless given.
S3 = {"region": "fs.s3a.endpoint.region", "access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "endpoint": "fs.s3a.endpoint"}
META = "dataset_id string, client_id string, doc_id string, sheet string, columns array<string>, dtypes map<string,string>, registered_at timestamp, meta string"


class Unsupported(ValueError):
    """No reader for this kind of file."""


def read(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """A file by its ending; typed: text columns as what they are."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xlsm"):
        from ledgerspark.sources import sheets, workbook

        return sheets.best(workbook.read(spark, path))[1]
    if kind not in READERS:
        raise Unsupported(f"no reader for .{kind}")
    df = READERS[kind](spark.read, path)
    return cleaning.inferred(df)[0] if typed else df


def s3_settings(region: str | None = None, access_key: str | None = None, secret_key: str | None = None, session_token: str | None = None, endpoint: str | None = None) -> dict[str, str]:
    """Hadoop settings for a store; paths instead of host names where an endpoint is given, temporary credentials where there
    is a token."""
    given = {k: v for k, v in locals().items() if k in S3 and v}
    out = {S3[k]: v for k, v in given.items()}
    if endpoint:
        out["fs.s3a.path.style.access"] = "true"
    if session_token:
        out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    return out


def view(spark: SparkSession, name: str, source: DataFrame | str, clean: bool = True) -> str:
    """A frame or a file as a view for SQL, under a plain name."""
    df = source if isinstance(source, DataFrame) else read(spark, source)
    plain = cleaning.sql_names([name])[0]
    (cleaning.registered(df) if clean else df).createOrReplaceTempView(plain)
    return plain


def scanned(spark: SparkSession, uri: str, sql: str | None = None) -> DataFrame:
    """A file, or what SQL makes of it; {table} stands for it there."""
    df = read(spark, uri)
    return spark.sql(sql, table=df) if sql else df


def described(df: DataFrame, samples: int = 3) -> str:
    """The columns, their types and a few values."""
    rows = df.limit(samples).collect()
    return "\n".join(f"- {n} ({t}): {', '.join(str(r[n]) for r in rows if r[n] is not None)}" for n, t in df.dtypes)


class Catalog:
    """Datasets are folders root/data/client_id=…/doc_id=…/sheet=…, named client:doc:sheet. Each has rows in root/meta, by
    tenant too, so that other tenants' files and rows aren't read. A tenant sees, loads and deletes its own only.

    A dataset's rows lie in a folder of their own for each time that it's registered, and the row of metadata, written last,
    names it: a dataset can be registered anew from itself, a write that fails leaves the old one, and what is being
    read stays until it's registered once more. Ids are kept in a filter as well, in root/ids; see known()."""

    def __init__(self, spark: SparkSession, root: str, datasets: int = 100_000):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.members = Membership(spark, f"{self.root}/ids", datasets)

    def parts(self, dataset: str, client: str | None = None) -> tuple[str, str, str]:
        """client, document and sheet as folders have them: missing ones are the given client, `misc` and `data`; of two parts
        the first names the document."""
        p = ids.parsed(dataset)
        doc = p["doc_id"] or (p["client_id"] if p["client_id"] else "misc")
        owner = p["client_id"] if p["doc_id"] else client
        named = cleaning.client_of(cleaning.tenant_of(owner))
        if "/" in (owner or "") or ".." in (owner or "") or named == "invalid":
            raise ValueError(f"invalid client: {owner!r}")
        return named, cleaning.path_part_of(doc), cleaning.path_part_of(p["sheet_name"] or "data")

    def at(self, dataset: str, client: str | None = None) -> str:
        return "{}/data/client_id={}/doc_id={}/sheet={}".format(self.root, *self.parts(dataset, client))

    def _id(self, dataset: str, client: str | None) -> str:
        return ":".join(self.parts(dataset, client))

    def _meta(self, key: str) -> str:
        client = key.split(":", 1)[0]
        return f"{self.root}/meta/client_id={client}/entry={hashlib.md5(key.encode()).hexdigest()}"

    def _owned(self, dataset: str, client: str) -> str | None:
        """The dataset's full id if it's the client's."""
        key = self._id(dataset, client)
        return key if key.split(":", 1)[0] == cleaning.tenant_of(client) else None

    def register(self, dataset: str, df: DataFrame, client: str | None = None, meta: dict | None = None) -> str:
        """Writes the frame and its row of metadata; gives its full id."""
        if not df.columns:
            raise ValueError("no columns")
        key = self._id(dataset, client)
        owner, doc, sheet = key.split(":", 2)
        before = self._named(key)
        at = f"{self.at(dataset, client)}/v={uuid.uuid4().hex}"
        df.write.parquet(at)
        row = self.spark.createDataFrame([(key, doc, sheet, df.columns, dict(df.dtypes), json.dumps(meta or {}), at.rsplit("/", 1)[1])], "dataset_id string, doc_id string, sheet string, columns array<string>, dtypes map<string,string>, meta string, folder string")
        row.withColumn("registered_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self._meta(key))
        for name in folders(self.spark, self.at(dataset, client)):
            if name.startswith("v=") and name not in (at.rsplit("/", 1)[1], before):
                deleted(self.spark, f"{self.at(dataset, client)}/{name}")
        if before is None:
            self.members.add(row, "dataset_id")
        self.view(dataset, owner)
        return key

    def _named(self, key: str) -> str | None:
        """The folder that a dataset's latest row names."""
        if not self._fs.exists(self._path(self._meta(key))):
            return None
        row = self.spark.read.schema("registered_at timestamp, folder string").parquet(self._meta(key)).orderBy(F.desc("registered_at")).first()
        return row.folder if row else None

    def all(self) -> DataFrame:
        """A row of metadata for each dataset, the latest."""
        if not self._fs.exists(self._path(f"{self.root}/meta")):
            return self.spark.createDataFrame([], META)
        schema = ", ".join(x for x in META.split(", ") if not x.startswith("client_id"))
        rows = self.spark.read.schema(schema + ", client_id string, entry string").parquet(f"{self.root}/meta").drop("entry")
        last = rows.groupBy("client_id", "dataset_id").agg(F.max_by(F.struct("doc_id", "sheet", "columns", "dtypes", "registered_at", "meta"), "registered_at").alias("r"))
        return last.select("dataset_id", "client_id", "r.doc_id", "r.sheet", "r.columns", "r.dtypes", "r.registered_at", "r.meta")

    def known(self, wanted: DataFrame, column: str = "dataset_id") -> DataFrame:
        """The wanted rows whose ids are registered: the filter leaves most others out before the metadata are read."""
        return self.members.among(wanted, column).join(self.all().select(F.col("dataset_id").alias("__id")), F.col(column) == F.col("__id"), "left_semi")

    def datasets(self, client: str) -> DataFrame:
        """The client's, oldest first, with the id of the document inside."""
        return self.all().where(F.col("client_id") == cleaning.tenant_of(client)).withColumn("doc", ids.document_of(F.col("dataset_id"))).orderBy("registered_at", "dataset_id")

    def load(self, dataset: str, client: str) -> DataFrame | None:
        """The client's frame; None if there is none or it's another's."""
        key = self._owned(dataset, client)
        folder = self._named(key) if key else None
        return self.spark.read.parquet(f"{self.at(dataset, client)}/{folder}") if folder else None

    def view(self, dataset: str, client: str) -> str:
        df = self.load(dataset, client)
        if df is None:
            raise ValueError(f"no dataset {dataset} of {client}")
        name = re.sub(r"[^a-z0-9]+", "_", self._id(dataset, client)).strip("_")
        df.createOrReplaceTempView(name)
        return name

    def exists(self, dataset: str, client: str) -> bool:
        return self.load(dataset, client) is not None

    def rehydrated(self, client: str, wanted: list[str] | None = None) -> tuple[list[str], list[str]]:
        """Views for the wanted datasets, or all of the client; those that are there, and those that aren't."""
        wanted = wanted if wanted is not None else [r.dataset_id for r in self.datasets(client).select("dataset_id").collect()]
        have = [d for d in wanted if self.load(d, client) is not None]
        for d in have:
            self.view(d, client)
        return have, [d for d in wanted if d not in have]

    def related(self, dataset: str, client: str) -> DataFrame:
        """The metadata of the datasets of the same document."""
        owner, doc, _ = self.parts(dataset, client)
        return self.all().where((F.col("client_id") == owner) & (F.col("doc_id") == doc))

    def delete(self, dataset: str, client: str) -> bool:
        """Deletes the client's dataset; False if it's none of its own."""
        key = self._owned(dataset, client)
        if key is None or not self._fs.exists(self._path(self.at(dataset, client))):
            return False
        self._fs.delete(self._path(self.at(dataset, client)), True)
        self._fs.delete(self._path(self._meta(key)), True)
        return True

    def metrics(self) -> DataFrame:
        """client_id, datasets, documents."""
        return self.all().groupBy("client_id").agg(F.count("*").alias("datasets"), F.count_distinct("doc_id").alias("documents"))

    def sheets(self, client: str) -> str:
        """What datasets there are, in words."""
        names = [r.sheet for r in self.datasets(client).select("sheet").limit(21).collect()]
        n = self.datasets(client).count()
        listed = "\n".join(f"  {i}. {s}" for i, s in enumerate(names[:20], 1))
        return f"There are {n} sheets:\n{listed}" + (f"\n  ... and {n - 20} more" if n > 20 else "")


class Ids:
    """One id for each user and namespace, kept as rows; asked again, the same comes back."""

    SCHEMA = "id string, user_id string, namespace string, created_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self._fs.exists(self._at(self.path)) else self.spark.createDataFrame([], self.SCHEMA)

    def create(self, user: str, namespace: str = "default") -> tuple[str, bool]:
        """The id, and whether it was there."""
        if not ids.valid_user(user):
            raise ValueError(f"invalid user: {user!r}")
        have = self.rows().where((F.col("user_id") == user) & (F.col("namespace") == namespace)).orderBy("created_at").first()
        if have:
            return have.id, True
        new = ids.short_id("id")
        row = self.spark.createDataFrame([(new, user, namespace)], "id string, user_id string, namespace string")
        row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(self.path)
        return new, False

    def of(self, user: str) -> DataFrame:
        return self.rows().where(F.col("user_id") == user).orderBy("created_at", "id")

    def reason(self, user: str, value: str) -> str:
        """`valid`, or why it isn't."""
        row = self.rows().where(F.col("id") == value).first()
        return "ID not found" if row is None else "valid" if row.user_id == user else "ID belongs to a different user"


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key), key, "left_anti")


def present(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key), key, "left_semi").select(*(F.col(c) for c in wanted.columns))
