"""Ids that must not change, as baselines name them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palisade.operators.coalesce import coalesced
from palisade.operators.correlate import correlate, public_chain
from palisade.operators.dependencies import dependencies, structural, structural_findings
from palisade.operators.detect import detect
from palisade.operators.findings import finding
from palisade.operators.keys import findings_of
from palisade.operators.units import collect_units

# Contents and the ids of what is found in them.
PROJECT = "https://abcdefghijklmnopqrst.supabase.co"
KEY = "sb_publishable_AbCdEfGhIjKlMnOpQrStUvWxYz0123456789"
PUBLISHABLE_ID, PUBLISHABLE_MARK = "supabase-key-38942064848800fd8268d46f", "c08ed0a02490113239074dc180fbf7ca"
BAD_NAME_ID, NO_VERSION_ID = "dependency-a21f190b20a81c18859ec3bd", "dependency-dac915b7a5944885eb177ed9"
CHAIN_ID = "correlation-bbe52f3871cc49267639496b"
FILES = "path string, content string, prov_kind string, sha string, author string, date string"


@pytest.mark.parametrize("path", ["src/app/page.tsx", "src/api/client.ts"])
def test_publishable_key(spark, path):
    text = f'const url = "{PROJECT}";\nconst key = "{KEY}";\n\nexport const load = () => fetch(url);\n'
    units = collect_units(spark.createDataFrame([(path, text, "working_tree", None, None, None)], FILES))
    (r,) = coalesced(findings_of(detect(units))).collect()
    assert (r.id, r.fingerprint, r.category, r.severity, r.key_class, r.project_url) == (PUBLISHABLE_ID, PUBLISHABLE_MARK, "key_classification", "info", "publishable_new", PROJECT)
    assert [(x.path, x.line, x.col_start, x.location_class) for x in r.locations] == [(path, 2, 14, "client_reachable")]
    assert r.evidence == f"PublishableNew sb_pub...6789 on {PROJECT} fingerprint {PUBLISHABLE_MARK}"


def test_malformed_dependencies(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies": {"Bad Package": "1.0.0", "left-pad": ""}}')], "path string, content string")
    found = structural_findings(structural(dependencies(files))).collect()
    assert {r.id: (r.rule_id, r.locations[0].path) for r in found} == {BAD_NAME_ID: ("invalid_package_name", "package.json"), NO_VERSION_ID: ("empty_version_specifier", "package.json")}


def _pair(spark):
    rows = spark.createDataFrame([("golden-key", "anon_legacy", "key_classification", None), ("golden-rls", None, "rls", "table profiles has RLS disabled")], "id string, key_class string, category string, proof string")
    place = F.expr("named_struct('path', 'src/app/page.tsx', 'line', 1, 'col_start', 1, 'col_end', 2, 'prov_kind', 'working_tree', 'sha', cast(null as string), 'shas', array(''), 'location_class', 'client_reachable')")
    return finding(rows, id=F.col("id"), category=F.col("category"), key_class=F.col("key_class"), project_url=F.lit(PROJECT + "/"), table=F.lit("profiles"), reproduction=F.col("proof"), locations=F.when(F.col("proof").isNull(), F.array(place)).otherwise(F.array()))


def test_chain(spark):
    rows = _pair(spark)
    (r,) = public_chain(rows).collect()
    assert (r.id, r.related, r.rule_id) == (CHAIN_ID, ["golden-key", "golden-rls"], "exposed-public-key-chain")
    assert r.evidence == "exposed-public-key-chain: table profiles has RLS disabled" and [x.path for x in r.locations] == ["src/app/page.tsx"]


def test_correlation_does_not_depend_on_order(spark):
    rows = _pair(spark)
    for order in (F.col("id"), F.col("id").desc()):
        assert [r.id for r in correlate(rows.orderBy(order).repartition(3)).collect()] == [CHAIN_ID]
