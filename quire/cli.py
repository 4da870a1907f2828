"""Commands over a store: python -m quire.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.chat import clean, rounds, summaries
from quire.plans.store import Store
from quire.sources.files import manifest_csv, manifest_jsonl


#: what --untrusted notes where no text is given
UNTRUSTED = "Scanned text that isn't to be trusted: check the context and other sources."


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, aliases=list(aliases))

    c = command("import", "import-book")
    c.add_argument("folder"), c.add_argument("--bucket", default="books"), c.add_argument("--tags", default=""), c.add_argument("--force", action="store_true")
    c.add_argument("--no-dir-tag", action="store_true"), c.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=True)
    for name, alias in (("chat", "import-chat"), ("onenote", "import-onenote")):
        c = command(name, alias)
        c.add_argument("folder"), c.add_argument("--bucket", default=name), c.add_argument("--tags", default=""), c.add_argument("--no-clean", action="store_true")
        c.add_argument("--auto-tags", action=argparse.BooleanOptionalAction, default=True)
    c = command("search")
    c.add_argument("query"), c.add_argument("--bucket"), c.add_argument("--tags"), c.add_argument("--limit", type=int, default=10)
    c.add_argument("--fulltext-only", action="store_true"), c.add_argument("--vector-only", action="store_true")
    c.add_argument("--category")
    c = command("find-book", "find-books")
    c.add_argument("query"), c.add_argument("--bucket"), c.add_argument("--tags"), c.add_argument("--limit", type=int, default=10)
    c = command("list", "list-books")
    c.add_argument("--bucket"), c.add_argument("--tags"), c.add_argument("--limit", type=int, default=50)
    command("buckets"), command("tags").add_argument("--bucket")
    c = command("read")
    c.add_argument("guid"), c.add_argument("seq", type=int), c.add_argument("--context", type=int, default=1)
    c = command("tag")
    c.add_argument("guid", nargs="?"), c.add_argument("--add", default=""), c.add_argument("--remove", default=""), c.add_argument("--audit", action="store_true"), c.add_argument("--sample", type=int, default=5)
    c = command("annotate", "note")
    c.add_argument("--from", dest="manifest"), c.add_argument("-g", "--guid", action="append", default=[]), c.add_argument("-p", "--path", action="append", default=[])
    c.add_argument("-u", "--untrusted", nargs="?", const=UNTRUSTED), c.add_argument("--replace", action="store_true"), c.add_argument("--show", type=int, default=20)
    c.add_argument("-y", "--yes", action="store_true")
    c = command("rm", "remove")
    c.add_argument("folder", nargs="?"), c.add_argument("--guid", action="append", default=[]), c.add_argument("--yes", action="store_true")
    command("emb").add_argument("--all", action="store_true")
    command("clean-chat").add_argument("input")
    command("vacuum"), command("images", "cleanup-images").add_argument("--yes", action="store_true")
    command("reset").add_argument("--yes", action="store_true")
    return p


def run(spark: SparkSession, args: list[str]) -> tuple[int, object]:
    """(exit code, result as JSON can hold it)."""
    a = parser().parse_args(args)
    s, name = Store(spark, a.store), a.command
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    if name in ("import", "import-book"):
        return 0, {"books": s.import_books(a.folder, a.bucket, a.tags, a.recursive, a.force, not a.no_dir_tag)}
    if name in ("chat", "import-chat"):
        return 0, {"chats": s.import_chats(a.folder, a.bucket, a.tags, not a.no_clean)}
    if name in ("onenote", "import-onenote"):
        return 0, {"notes": s.import_notes(a.folder, a.bucket, a.tags, a.auto_tags)}
    if name == "search":
        r = s.search(a.query, bucket=a.bucket, tags=a.tags, limit=a.limit, fulltext_only=a.fulltext_only, vector_only=a.vector_only, category=a.category)
        return 0, {"results": rows(r.results), "search_meta": r.meta}
    if name in ("find-book", "find-books"):
        r = s.find_books(a.query, a.bucket, a.tags, a.limit)
        return int("error" in r), {k: v if isinstance(v, str) else rows(v) for k, v in r.items()}
    if name in ("list", "list-books"):
        return 0, rows(s.list_books(a.bucket, a.tags, a.limit))
    if name == "buckets":
        return 0, rows(s.list_buckets())
    if name == "tags":
        return 0, rows(s.list_tags(a.bucket))
    if name == "read":
        r = s.read_chunk(a.guid, a.seq, a.context)
        return int("error" in r), r
    if name == "tag":
        if a.audit:
            counts, samples = s.audit_tags(a.sample)
            got = rows(counts)
            return int(any(c["defect"] != "empty" for c in got)), {"counts": got, "samples": rows(samples)}
        return 0, s.tag(a.guid, a.add, a.remove)
    if name in ("annotate", "note"):
        direct = bool(a.guid or a.path)
        if bool(a.manifest) == direct or direct and a.untrusted is None:
            return 2, {"error": "a manifest, or guids and paths with --untrusted"}
        if direct:
            rows_ = [(g, None) for g in a.guid] + [(None, p) for p in a.path]
            m = spark.createDataFrame([((g, None, p, None), None, None, a.untrusted, "annotate:--untrusted") for g, p in rows_],
                                      "match struct<guid:string,content_md5:string,source_path:string,title:string>, errata map<string,int>, glossary map<string,string>, note string, source string")
        else:
            m = manifest_csv(spark, a.manifest) if a.manifest.endswith(".csv") else manifest_jsonl(spark, a.manifest)
        for c, kind in (("errata", "map<string,int>"), ("glossary", "map<string,string>"), ("note", "string"), ("source", "string")):
            if c not in m.columns:
                m = m.withColumn(c, F.lit(None).cast(kind))
        fields = {f.name for f in m.schema["match"].dataType.fields}
        m = m.withColumn("match", F.struct(*[(F.col(f"match.{k}") if k in fields else F.lit(None).cast("string")).alias(k) for k in ("guid", "content_md5", "source_path", "title")]))
        plan = s.annotate(m, apply=a.yes, replace=a.replace).persist()
        counts = {r["state"]: r["n"] for r in plan.groupBy("state").agg(F.count("*").alias("n")).collect()}
        # the first of each state are shown, all are counted
        first = plan.withColumn("_n", F.row_number().over(Window.partitionBy("state").orderBy("row"))).where(F.col("_n") <= a.show).drop("_n")
        return int(any(k != "matched" for k in counts)), {"counts": counts, "plan": rows(first.orderBy("state", "row"))}
    if name in ("rm", "remove"):
        if bool(a.folder) == bool(a.guid):
            return 2, {"error": "a folder or guids, not both"}
        which = s.under(a.folder) if a.folder else spark.createDataFrame([(g,) for g in a.guid], "guid string")
        r = s.remove(which, dry_run=not a.yes)
        return int(bool(r["missing"])), r
    if name == "emb":
        return 0, {"removed": s.clean_cache(a.all)}
    if name == "clean-chat":
        f = spark.read.text(a.input, wholetext=True).select(F.lit(1).alias("id"), F.col("value").alias("text"))
        c = clean(f, "id", "text")
        return 0, {"cleaned": c.first()["cleaned"], "summary": summaries(rounds(c, "id"), f, "id").first()["summary"]}
    if name in ("images", "cleanup-images"):
        return 0, {"images": s.table("image").count(), "unused": s.clean_images(dry_run=not a.yes), "removed": a.yes}
    if name == "vacuum":
        return 0, {"folders": s.vacuum()}
    if not a.yes:
        return 1, {"error": "reset needs --yes"}
    s.reset()
    return 0, {}


def main() -> None:
    code, out = run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    print(json.dumps(out, ensure_ascii=False, default=str))
    sys.exit(code)


if __name__ == "__main__":
    main()
