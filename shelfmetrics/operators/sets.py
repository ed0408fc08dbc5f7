"""Set membership with SQL's three-valued logic."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` with key NOT IN (right.key). One NULL on the right leaves nothing, and a NULL on the left passes
    only an empty right. Written as an anti join and two counts: the built-in form broadcasts the right side whatever its size."""
    known = right.select(key)
    rows, nulls = known.agg(F.count("*")).scalar(), known.agg(F.count_if(F.col(key).isNull())).scalar()
    return left.join(known, key, "left_anti").filter((rows == 0) | ((nulls == 0) & F.col(key).isNotNull()))
