"""Questions become queries over the described tables, or are refused."""

import pytest

from millrace.operators import asking, sqlguard

TABLES = "open_customer(c_custkey bigint, c_nationkey bigint, c_acctbal double, c_mktsegment string)\nopen_nation(n_nationkey bigint, n_name string)"


def test_queries_are_written():
    assert asking.write_query("How many customers?", TABLES) == "SELECT count(*) AS `n` FROM `open_customer`"
    got = asking.write_query("What is the lowest acctbal of customers per name with mktsegment is O'Brien and acctbal over -3.5?", TABLES)
    assert got == (
        "SELECT `open_nation`.`n_name`, min(`open_customer`.`c_acctbal`) AS `min_acctbal` FROM `open_customer` JOIN `open_nation` ON "
        "`open_customer`.`c_nationkey` = `open_nation`.`n_nationkey` WHERE lower(`open_customer`.`c_mktsegment`) = 'o''brien' AND `open_customer`.`c_acctbal` > -3.5 GROUP BY `open_nation`.`n_name`"
    )


@pytest.mark.parametrize("question", ["Drop the customers", "How many dragons?", "The average colour of customers?", "How many customers with acctbal over much?", "How many customers with sun?", "The total key of customers"])
def test_what_does_not_match_is_refused(question):
    with pytest.raises(sqlguard.Refused):
        asking.write_query(question, TABLES)
