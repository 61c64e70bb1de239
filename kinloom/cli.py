"""Command line: python -m kinloom.cli manifest|cluster|report|verify ..."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import functions as F

from .config import Settings
from .functions.vector import unit
from .operators import cluster, thresholds
from .session import cut, session
from .sources import listing, results, tables


def _faces(spark, path, version):
    f = tables.read_faces(spark, path, version)
    return f.select("event_id", "face_id", "photo_id", unit(F.col("embedding")).alias("x"), F.col("quality_score").alias("quality"), F.col("face_h_px").alias("height"))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinloom", description="Group faces into identities.")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("manifest", help="list a folder's images")
    m.add_argument("folder")
    m.add_argument("out")
    for name, text in (("cluster", "group faces and keep the result"), ("report", "write a page about the result of each event into a folder")):
        c = sub.add_parser(name, help=text)
        c.add_argument("faces")
        c.add_argument("version")
        c.add_argument("out")
        c.add_argument("--auto", action="store_true", help="choose the merge line from the data")
    v = sub.add_parser("verify", help="check that a folder can be read")
    v.add_argument("folder")
    a = p.parse_args(argv)
    spark, s = session(), Settings.from_env()
    if a.command == "manifest":
        listing.manifest(listing.scan_folder(spark, a.folder)).write.mode("overwrite").json(a.out)
    elif a.command == "verify":
        try:
            print(listing.scan_stats(listing.scan_folder(spark, a.folder)).first().asDict())
        except Exception as e:
            print(f"can't be read: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
    else:
        faces = _faces(spark, a.faces, a.version)
        line = None
        if a.auto:
            line = cut(thresholds.merge_line(thresholds.same_photo_pairs(faces)).select("event_id", "line"))  # each event its own
        found = cluster.identities(faces, s, line)
        if a.command == "cluster":
            results.keep_result(found, a.out, s.signature() + (":line=auto" if a.auto else ""))
        else:
            members = faces.join(found, ["event_id", "face_id"])
            pages = results.report(cluster.person_table(faces, found), members, {"signature": s.signature()})
            os.makedirs(a.out, exist_ok=True)
            for page in pages.toLocalIterator():  # one event's at a time
                with open(os.path.join(a.out, re.sub(r"[^A-Za-z0-9_.-]", "_", str(page["event_id"])) + ".html"), "w", encoding="utf-8") as f:
                    f.write(page["html"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
