"""Queries on packed fields."""

from tallyloom.operators.packed import packed_values
from tallyloom.plans.registry import Registry
from tallyloom.session import table

R = Registry()

FIELDS = {"sender": "address", "name": "name", "cc_bcc": "address", "links": "link"}


@R.query()
def p3_found(spark, d):
    return packed_values(table(spark, d, "raw").select("_id", *FIELDS), id_col="_id", fields=FIELDS)
