"""Whole exports."""

import re

from tracklens.plans import registry
from tracklens.plans.adapters import view

SF = "/root/testdata/sf0.001"


def test_xml_export_holds_the_crates_of_all_users(spark):
    users = {r[0] for r in view(spark, SF, "events").where("event_type = 'click'").select("user_id").distinct().collect()}
    lines = registry.QUERIES["s14_xml_export"](spark, SF).collect()
    found = {int(x) for r in lines for x in re.findall(r'"Crate (\d+)"', " ".join(map(str, r)))}
    assert found == users
