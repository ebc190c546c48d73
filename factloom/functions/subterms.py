"""Terms as a table function: the nodes of a term, for queries in SQL."""

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from factloom.terms import canon, nodes, parse


@udtf(returnType="path string, kind string, arity int, sym string, sub string", useArrow=True)
class Subterms:
    """A row for the term and each term inside, before their parts. Null and unreadable texts have none."""

    def eval(self, term: str):
        try:
            parsed = None if term is None else canon(parse(term))
        except ValueError:
            return
        if parsed is not None:
            yield from nodes(parsed)


def register(spark: SparkSession, name: str = "subterms") -> None:
    spark.udtf.register(name, Subterms)
