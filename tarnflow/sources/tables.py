"""Tables from bulk files, archives, remote snapshots and paged services, and their sinks."""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of columns by their other spellings (fixed values).
ALIASES = {
    "decimallongitude": "longitude", "decimallatitude": "latitude",
    "coordinateuncertaintyinmeters": "coordinateUncertaintyInMeters", "basisofrecord": "basisOfRecord",
    "occurrencestatus": "occurrenceStatus", "datasetkey": "datasetKey", "taxonkey": "taxonKey",
    "acceptedtaxonkey": "acceptedTaxonKey", "scientificname": "scientificName",
    "acceptedscientificname": "acceptedScientificName", "taxonrank": "taxonRank", "countrycode": "countryCode",
    "institutioncode": "institutionCode", "eventdate": "eventDate", "gbifid": "gbifID", "key": "gbifID",
}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Columns under their usual names, the first of each; ``species`` from the accepted or scientific name if absent."""
    seen, out = set(), []
    for c in df.columns:
        name = ALIASES.get(c, ALIASES.get(c.lower(), c))
        if name not in seen:
            seen.add(name)
            out.append(F.col(f"`{c}`").alias(name))
    df = df.select(*out)
    if "species" not in seen:
        source = next((c for c in ("acceptedScientificName", "scientificName") if c in seen), None)
        if source:
            df = df.withColumn("species", F.col(source))
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its suffix, else CSV with a header."""
    if path.lower().endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, sep="\t" if path.lower().endswith((".tsv", ".txt")) else ",")


def pick_member(names: Sequence[str]) -> str:
    """The first Parquet member, else the table whose name says occurrence, then the shortest."""
    if parquet := [n for n in names if n.lower().endswith(".parquet")]:
        return parquet[0]
    tables = [n for n in names if n.lower().endswith((".txt", ".tsv", ".csv"))]
    if not tables:
        raise ValueError("no table in the archive")
    return min(tables, key=lambda n: ("occurrence" not in n.lower(), len(n)))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated member of an archive: a task streams its lines, Spark splits and spreads them."""
    from pyarrow import fs

    def opened():
        store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return zipfile.ZipFile(store.open_input_file(where))

    with opened() as z:
        member = pick_member(z.namelist())
        if member.lower().endswith(".parquet"):
            raise ValueError("unpack an archive of Parquet and read it as a folder")
        with z.open(member) as f:
            names = io.TextIOWrapper(f, "utf-8").readline().rstrip("\r\n").split("\t")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0).to_pylist():
                with opened() as z, z.open(m) as f:
                    text, held = io.TextIOWrapper(f, "utf-8", errors="replace"), []
                    next(text, None)
                    for line in text:
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["line"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["line"])

    rows = spark.createDataFrame([(member,)], "member string").mapInArrow(lines, "line string").withColumn("_p", F.split("line", "\t"))
    return rows.select(*[F.nullif(F.get("_p", i), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_bulk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, provenance) of a bulk file by its suffix; the provenance has bytes and a checksum of parts that Spark sums."""
    low = path.lower()
    if low.endswith(".zip"):
        rows = read_zip(spark, path)
    elif low.endswith((".tsv", ".txt", ".csv", ".parquet", ".pq")):
        rows = read_table(spark, path)
    else:
        raise ValueError(f"no reader for {path}")
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    rows = normalise_columns(rows)
    return rows, files.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_rows"))))


def read_projected_csv(spark: SparkSession, path: str, columns: Sequence[str], taxa: Sequence[str], taxon: str = "species") -> DataFrame:
    """Some columns of some taxa of a CSV; Spark splits the file and prunes columns while parsing."""
    return spark.read.csv(path, header=True).where(F.col(taxon).isin(list(taxa))).select(*columns)


def snapshot_uri(provider: str, month: str, region: str = "us-east-1") -> str:
    """Where the public monthly snapshot of ``month`` lies; it must be the first of a month."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-01", month):
        raise ValueError("the first of a month, as YYYY-MM-01")
    regions = ("af-south-1", "ap-southeast-2", "eu-central-1", "sa-east-1", "us-east-1")
    if provider == "aws" and region in regions:
        return f"s3a://gbif-open-data-{region}/occurrence/{month}/occurrence.parquet"
    if provider == "azure":
        return f"wasbs://gbif@ai4edataeuwest.blob.core.windows.net/occurrence/{month}/occurrence.parquet"
    raise ValueError("unknown provider or region")


_DOI = re.compile(r"10\.\d{4,9}/[-._;()/:a-z0-9]+", re.IGNORECASE)


def citation_doi(fetch: Callable[[], tuple[int, str]], expected: str | None = None, attempts: int = 6, sleep: Callable[[float], None] = time.sleep) -> str:
    """The DOI in a citation text; busy answers are tried again after 1, 2, 4 ... at most 16 s."""
    for i in range(attempts):
        status, text = fetch()
        if status == 429 or status >= 500:
            sleep(min(2.0**i, 16.0))
            continue
        found = _DOI.search(text)
        if not found:
            raise ValueError("no DOI in the citation")
        doi = found[0].rstrip(".")
        if expected and doi.lower() != expected.lower():
            raise ValueError(f"the citation has {doi}, not {expected}")
        return doi
    raise TimeoutError("the citation service stays busy")


def extract_snapshot(df: DataFrame, path: str, doi: str, query: str) -> DataFrame:
    """Writes an extract as zstd Parquet, never over another, with a provenance table beside it; returns what was written."""
    if not _DOI.fullmatch(doi):
        raise ValueError("an extract needs a DOI")
    from tarnflow.functions.values import canonical_hash

    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    out = spark.read.parquet(path)
    spark.createDataFrame([(doi, query, canonical_hash(query), out.count())], "doi string, query string, query_hash string, n_rows long").write.mode("errorifexists").json(path.rstrip("/") + "_provenance")
    return out


class BulkDownloadRequired(ValueError):
    """A search matches more rows than a paged service gives."""


PAGE, MOST_ROWS = 300, 100_000


def search_occurrences(spark: SparkSession, get_json: Callable[[dict], dict], query: dict, schema: str, page: int = PAGE) -> DataFrame:
    """All pages of a search as rows: the driver asks for the count alone, tasks fetch the pages."""
    if not 0 < page <= PAGE:
        raise ValueError(f"pages of 1 to {PAGE}")
    total = int(get_json({**query, "limit": 0, "offset": 0})["count"])
    if total > MOST_ROWS:
        raise BulkDownloadRequired(f"{total} rows; the service gives {MOST_ROWS}")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                rows = get_json({**query, "limit": page, "offset": at})["results"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in rows])], names=["record"])

    pages = spark.range(0, max(total, 1), page, numPartitions=max(1, min(16, -(-total // page))))
    return pages.mapInArrow(fetch, "record string").select(F.from_json("record", schema).alias("r")).select("r.*")


def match_taxon(answer: dict) -> tuple[str, str]:
    """(key, name) of a matched taxon, its accepted usage if there is one."""
    usage = answer.get("acceptedUsage") or answer.get("usage") or {}
    if "key" not in usage:
        raise ValueError("no match")
    return str(usage["key"]), usage.get("name", "")


def scan_artifacts(spark: SparkSession, root: str, purpose: str, expected: int | None = None, demand: Mapping[str, object] | None = None) -> DataFrame:
    """(folder, contract columns) of the JSON contracts below ``root`` with a purpose; each folder once, as many as expected.

    Columns that ``demand`` names must have its value in every contract, or the scan fails.
    """
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "contract.json").json(root)
    found = found.select("*", _folder().alias("folder")).where(F.col("purpose") == purpose)
    wrong = [F.count_if(~F.coalesce(F.col(c).eqNullSafe(F.lit(v)), F.lit(False))).alias(f"wrong_{c}") for c, v in (demand or {}).items()]
    n, distinct, *bad = found.agg(F.count("*"), F.countDistinct("folder"), *wrong).first()
    if n != distinct or (expected is not None and n != expected):
        raise ValueError(f"{n} contracts in {distinct} folders, expected {expected}")
    if any(bad):
        raise ValueError("contracts break their demands: " + ", ".join(c for c, k in zip(demand or (), bad, strict=True) if k))
    return found


def _folder() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")


def read_siblings(spark: SparkSession, root: str, contracts: DataFrame, kinds: Mapping[str, str], keys: Sequence[str], optional: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The CSV tables beside the contracts, by file name: every row with the columns of its folder's contract.

    ``kinds`` gives each file's schema, so that all folders are read as one table without a look into each; rows are
    joined to contracts by folder, and files elsewhere are left out. A contract without any row of a kind that is not
    ``optional`` fails its table when that is read, as do contracts that share the values of ``keys``. A column of a table
    that a contract has as well keeps the table's value.
    """
    same = F.count("*").over(Window.partitionBy(*keys))
    # in filters, which no column pruning takes away
    refuse = lambda bad, text: F.when(bad, F.raise_error(F.concat(F.lit(text), F.col("folder"))).cast("boolean")).otherwise(True)
    held = contracts.withColumn("_same", same).where(refuse(F.col("_same") > 1, "contracts share their keys: ")).drop("_same")
    out = {}
    for name, schema in kinds.items():
        found = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
        rows = found.select(_folder().alias("folder"), F.lit(True).alias("_there"), "*")
        mine = held.select(*[c for c in held.columns if c not in found.columns])
        if name in optional:
            out[name] = mine.join(rows, "folder").drop("_there")
            continue
        both = mine.join(rows, "folder", "left")
        out[name] = both.where(refuse(F.col("_there").isNull(), f"no rows of {name} in ")).drop("_there")
    return out


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines key=value; empty lines and comments are left out, a key may not repeat."""
    lines = spark.read.text(path).where("trim(value) <> '' and trim(value) not like '#%'")
    out = lines.select(F.trim(F.split_part("value", F.lit("="), F.lit(1))).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("value"))
    from tarnflow.functions.values import assert_unique

    return assert_unique(out, ["key"], "choices")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    """A new table as Parquet, CSV with a header, or JSON lines; an existing one is refused."""
    out = df.write.mode("errorifexists").partitionBy(*partition) if partition else df.write.mode("errorifexists")
    {"parquet": lambda: out.parquet(path), "csv": lambda: out.option("header", True).csv(path), "json": lambda: out.json(path)}[fmt]()


FAMILIES = ("gaussian", "asymmetric", "soft_threshold", "interaction", "omitted_driver", "observation_confounded")


def known_truth(spark: SparkSession, cells: int, family: str, seed: int) -> DataFrame:
    """A landscape with a known response: (cell, longitude, latitude, temperature, water, noise, recording_bias,
    true_suitability, sampling_effort, is_presence), made where it lies from hashes of cell and seed."""
    if family not in FAMILIES:
        raise ValueError(f"one of {', '.join(FAMILIES)}")
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "cell"), F.lit(1 << 30)) / float(1 << 30)
    df = spark.range(cells).withColumnRenamed("id", "cell").withColumns({"longitude": u(1) * 360 - 180, "latitude": u(2) * 180 - 90, "noise": u(3), "recording_bias": u(4), "_hidden": u(5)})
    df = df.withColumns({"temperature": F.cos(F.radians("latitude")) + (u(6) - 0.5) * 0.3, "water": (F.sin(F.radians(F.col("longitude") * 2)) + 1) / 2 + (u(7) - 0.5) * 0.2})
    t, w = F.col("temperature"), F.col("water")
    bell = lambda x, m, s: F.exp(-((x - m) ** 2) / (2 * s * s))
    truth = {
        "gaussian": bell(t, 0.6, 0.2) * bell(w, 0.5, 0.3), "asymmetric": F.when(t < 0.6, bell(t, 0.6, 0.1)).otherwise(bell(t, 0.6, 0.4)),
        "soft_threshold": 1 / (1 + F.exp(-12 * (t - 0.5))), "interaction": 1 / (1 + F.exp(-8 * (t * w - 0.3))),
        "omitted_driver": bell(t, 0.6, 0.3) * F.col("_hidden"), "observation_confounded": bell(t, 0.6, 0.25),
    }[family]
    effort = F.when(F.lit(family == "observation_confounded"), 0.2 + 0.8 * F.col("recording_bias") * t).otherwise(F.lit(1.0))
    out = df.withColumns({"true_suitability": truth, "sampling_effort": effort}).drop("_hidden")
    return out.withColumn("is_presence", u(8) < F.col("true_suitability") * F.col("sampling_effort"))
