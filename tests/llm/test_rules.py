"""Url patterns against running all of them; licence expressions and long texts."""

import random
import re
import time

import pytest

from signaldesk.llm import licenses, url_filters


def test_urls_equal_running_every_pattern(spark):
    rng = random.Random(1)
    words = ["casino", "casinos", "free", "bets", "free-bets", "utm_source=popunder", "utm_source=popunder2", "popunder", "login", "cgi-bin", "wp-admin", "sessionid=af1",
             "sessionid", "adult", "ads-track", "cheap-pills", "a", "é", "0"]
    rows = [(i, rng.choice(["http://x.org", "HTTP://Y.de", "www.z.fr", ""]) + "".join(rng.choice("/?&.-#;=") + rng.choice(words) for _ in range(rng.randint(0, 5)))) for i in range(1500)]
    rows += [(9001, "http://x.org/?utm_source=popunder2"), (9002, "www.x.org/casino.html"), (9003, None), (9004, ""), (9004, ""), (9005, "http://x.org/" + "a/" * 40_000 + "login")]
    found = {(r["page_id"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), hosts=()).collect()}
    blocks = [re.compile(r.pattern) for r in url_filters.PATTERN_RULES]
    assert found == {(i, "block" if any(b.search((u or "").lower()) for b in blocks) else "allow") for i, u in rows}
    verdicts = dict(found)
    assert (verdicts[9001], verdicts[9002], verdicts[9005]) == ("allow", "block", "block")


def test_a_pattern_must_bound_its_tokens():
    with pytest.raises(ValueError):
        url_filters.PatternRule("block", ("popunder",), "[?&]utm_source=popunder")


@pytest.mark.parametrize("line, labels, alike", [
    ("gpl-3.0 or mit", {"gpl", "mit"}, False), ("gpl-3.0 and mit", {"gpl", "mit"}, True), ("gpl-2.0-only with x or mpl-2.0", {"gpl", "mpl"}, True),
    ("mit or gpl-2.0 and bsd-3-clause", {"mit", "gpl", "bsd"}, False), ("(mit or gpl-2.0) and agpl-3.0", {"mit", "gpl", "agpl"}, True),
    ("mit */", {"mit"}, False), ("mit or", {"mit"}, False), ("(mit", set(), False), ("mit) and gpl", {"mit"}, False), ("", set(), False), ("or mit", set(), False),
    ("mit or (gpl-2.0 and", {"mit"}, False), ("mit apache-2.0", {"mit"}, False)])
def test_expressions_decide(line, labels, alike):
    assert licenses.expression_labels(line.encode()) == (labels, alike)


def test_expressions_of_texts(spark):
    rows = [(1, "SPDX-License-Identifier: GPL-3.0 OR MIT"), (2, "SPDX-License-Identifier: GPL-3.0 AND MIT"), (3, "SPDX-License-Identifier: MIT\nGeneral Public License"), (4, None)]
    found = {r["doc_id"]: (r["labels"], r["share_alike"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("gpl,mit", False), 2: ("gpl,mit", True), 3: ("gpl,mit", True), 4: ("", False)}


def test_long_texts_take_linear_time():
    import pandas as pd

    line = b"(mit or " * 8_000
    texts = [b"SPDX-License-Identifier: " + line, b"SPDX-License-Identifier: MIT and\n" * 20_000, b"the mit license and " * 100_000]
    start = time.time()
    rows = pd.concat(licenses._scan([pd.DataFrame({"doc_id": [1, 2, 3], "text": texts})]))
    assert time.time() - start < 20
    assert rows["n_base"].tolist() == [0, 0, 100_000] and rows["last_word"].tolist()[2] == 4 * 99_999 + 1
    assert rows["labels"].tolist() == ["", "mit", "mit"]


@pytest.mark.parametrize("arguments, fault, canonical", [
    ('{"query":"x","limit":5}', None, '{"limit":5,"query":"x"}'), ('{"query":"x","limit":"5"}', "limit is no integer", '{"limit":"5","query":"x"}'),
    ('{"query":7}', "query is no string", '{"query":7}'), ('{"query":null}', "query is no string", '{"query":null}'), ('{"limit":2}', "missing query", '{"limit":2}'),
    ('{"query":"x","deep":{"b":[1,{"d":true,"c":null}],"a":"y"}}', "unexpected deep", '{"deep":{"a":"y","b":[1,{"c":null,"d":true}]},"query":"x"}'),
    ('{"query":"é\\"\\n","limit":1.5}', "limit is no integer", '{"limit":1.5,"query":"é\\"\\n"}'), ("[1]", "arguments are no object", "[1]"), ("null", "arguments are no object", "null"),
    ('{"query":"x","limit":98765432109876543210}', None, '{"limit":98765432109876543210,"query":"x"}')])
def test_arguments_keep_their_types(spark, arguments, fault, canonical):
    from signaldesk.llm import chat_tools

    text = f'{{"tool_calls":[{{"id":"a","name":"search","arguments":{arguments}}}]}}'
    row = chat_tools.link_tools(spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn int, role string, text string")).first()
    assert (row["fault"], row["json"]) == (fault, f'{{"arguments":{canonical},"id":"a","name":"search"}}')
