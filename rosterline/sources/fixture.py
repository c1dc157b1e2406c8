"""Mail fixture derived from the ``customer`` table.

The two column lists are plain SQL that Spark and DuckDB both accept; the
oracle uses the same lists, so that both engines start from equal bodies.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions.frames import spread

_N = "chr(10)"


def _item(names: str, index: str) -> str:
    sep = ";" if ";" in names else ","
    return f"split_part('{names}', '{sep}', cast({index} as int))"


PARTS = {
    "k": "c_custkey",
    "person": "concat("
    + _item("Anna,Brian,Carla,David,Elena,Frank,Grace,Henry", "c_custkey % 8 + 1")
    + ", ' ', "
    + _item("Abbott,Barnes,Castro,Dalton,Ellis,Fisher,Garner,Hughes,Ingram,Jensen", "floor(c_custkey / 8) % 10 + 1")
    + ")",
    "npi": "cast(1000000000 + c_custkey * 7919 as string)",
    "npi2": "cast(1500000000 + c_custkey as string)",
    "npi3": "cast(1600000000 + c_custkey as string)",
    "gnpi": "cast(1900000000 + cast(c_nationkey as bigint) * 104729 as string)",
    "tin": "concat(substr(cast(100000000 + c_custkey * 6151 as string), 1, 2), '-', "
    "substr(cast(100000000 + c_custkey * 6151 as string), 3, 7))",
    "lic": "concat(chr(cast(65 + c_custkey % 26 as int)), lpad(cast(10000 + c_custkey % 90000 as string), 5, '0'))",
    "phone": "concat('(', cast(200 + c_custkey % 700 as string), ') 555-', lpad(cast(c_custkey % 10000 as string), 4, '0'))",
    "fax": "concat(cast(200 + c_custkey % 700 as string), '-556-', lpad(cast(c_custkey % 10000 as string), 4, '0'))",
    "spec": _item("Internal Medicine,Cardiology,peds,Orthopedics,Family Practice,obgyn,Dermatolgy", "c_custkey % 7 + 1"),
    "org": _item("Summit Health,Westside Medical Group,HeartCare Associates,Pine Clinic", "c_custkey % 4 + 1"),
    "lob": _item("Medicare;Commercial HMO;Medi-Cal, PPO;Part B", "c_custkey % 4 + 1"),
    "ppg": "concat('P', cast(100 + c_custkey % 800 as string))",
    "dt": "concat(lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '/', "
    "lpad(cast(1 + c_custkey % 28 as string), 2, '0'), '/', cast(2025 + c_custkey % 2 as string))",
    "ask": _item(
        "Please add the following provider,Please update the address for the provider,"
        "Please terminate the following provider", "c_custkey % 3 + 1"),
}


def _text(*pieces: str) -> str:
    """Concatenation; ``{x}`` is a column, ``\\n`` a line break, the rest literal."""
    out = []
    for piece in "".join(pieces).replace("{", "\0{").replace("}", "}\0").replace("\n", "\0\n\0").split("\0"):
        if piece == "\n":
            out.append(_N)
        elif piece.startswith("{"):
            out.append("concat('Dr. ', person)" if piece == "{name}" else piece[1:-1])
        elif piece:
            out.append("'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join(out) + ")"


_KEY_VALUE = [
    ("Provider Name", "{name}"), ("Provider NPI", "{npi}"), ("Specialty", "{spec}"), ("State License", "{lic}"),
    ("Organization", "{org}"), ("TIN", "{tin}"), ("Group NPI", "{gnpi}"), ("Phone Number", "{phone}"),
    ("Fax Number", "{fax}"), ("PPG ID", "{ppg}"), ("Line of Business", "{lob}"), ("Effective Date", "{dt}"),
]

_OLD_NPI = "{CASE WHEN k % 2 = 0 THEN npi ELSE npi3 END}"
_BODIES = [
    "Dear Team,\n\n{ask}.\n\n" + "\n".join(f"{k}: {v}" for k, v in _KEY_VALUE) + "\n\nRegards,\nNetwork Ops",
    "Hi Team,\n\n{ask}s.\n\nProvider Name | NPI | Specialty | License\n{name} | {npi} | {spec} | {lic}\n"
    "Dr. Second Person | {npi2} |  | {lic}\n\nThanks,\nOps",
    "Hello,\n\nProvider 1: {name} | NPI: {npi} | License: {lic}\nShared Risk: {org} - {ppg}\n"
    "Provider 2: Dr. Other Name | NPI: {npi2}\n\n\n\nThank you",
    "{ask} {name}, effective {dt}. Call Phone: {fax}. The NPI is NPI {npi} and LOB is {lob}.\n"
    "-----Original Message-----\nFrom: a@example.com\nNPI: " + _OLD_NPI,
    "Hello,\n{name} will no longer be with us after 22nd September 2025 due to retirement.\n"
    "This email is confidential.\nRegards",
]

_HTML_HEAD = "<html><head><style>/* plain */</style></head><body><!-- mail body -->"
_HTML = [
    _HTML_HEAD + "<p>Dear Team,</p><p>{ask}.</p><table>"
    + "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in _KEY_VALUE)
    + "</table><p>Regards,<br>Network Ops</p></body></html>",
    _HTML_HEAD + "<p>Hi Team,</p><p>{ask}s.</p><table border=\"1\"><tr><th><b>Provider Name</b></th><th>NPI</th>"
    "<th>Specialty</th><th>License</th></tr><tr><td>{name}</td><td>{npi}</td><td>{spec}</td><td>{lic}</td></tr>"
    "<tr><td>Dr. Second Person</td><td>{npi2}</td><td></td><td>{lic}</td></tr></table><p>Thanks,<br>Ops</p></body></html>",
]


def _html_cases() -> str:
    lines = f"replace(body, {_N}, '</p><p>')"
    return (
        f"CASE layout WHEN 0 THEN {_text(_HTML[0])} WHEN 1 THEN {_text(_HTML[1])} "
        f"ELSE concat('{_HTML_HEAD}<p>', {lines}, '</p></body></html>') END"
    )


BODY = "CASE k % 5 " + " ".join(f"WHEN {i} THEN {_text(b)}" for i, b in enumerate(_BODIES)) + " END"
PARTS_SQL = [f"{expr} AS {name}" for name, expr in PARTS.items()]
MAIL_SQL = ["k", "k AS msg_id", "k % 5 AS layout", f"{BODY} AS body", *[p for p in PARTS if p != "k"]]
HTML_SQL = _html_cases()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def columns(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table."""
    return table(spark, sf_dir, name).select(*cols)


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, layout, body``: one mail per customer."""
    return rendered(spark, sf_dir).select("msg_id", "layout", "body")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the body and its parts."""
    return dealt(table(spark, sf_dir, "customer")).selectExpr(*PARTS_SQL).selectExpr(*MAIL_SQL)


def dealt(customer: DataFrame) -> DataFrame:
    """Keys of the mails of a table or stream, dealt to as many tasks as a shuffle has.

    A narrow table of very many keys is read by one task.  Two columns are dealt
    by key; the mails that are made of them stay where they are made.
    """
    return customer.select("c_custkey", "c_nationkey").transform(spread, "c_custkey")


def mail_of(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(*PARTS_SQL).selectExpr(*MAIL_SQL).select("msg_id", "layout", "body")


def mail_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``msg_id, layout, body, html``."""
    return rendered(spark, sf_dir).selectExpr("msg_id", "layout", "body", f"{HTML_SQL} AS html")


#: of three mails one is plain text, one HTML alone, and one has both parts
TEXT_PART_SQL = "CASE WHEN msg_id % 3 = 1 THEN '' ELSE body END"
HTML_PART_SQL = "CASE WHEN msg_id % 3 <> 0 THEN html END"


def messages(spark: SparkSession, sf_dir: str, html: bool = False) -> DataFrame:
    """Fixture mails in the message schema: plain text, or a mix of text and HTML parts."""
    if html:
        return mail_html(spark, sf_dir).selectExpr("msg_id", f"{TEXT_PART_SQL} AS text_content", f"{HTML_PART_SQL} AS html_content")
    return mail(spark, sf_dir).selectExpr("msg_id", "body AS text_content", "cast(null as string) AS html_content")
