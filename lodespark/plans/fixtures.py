"""Fixture views over the driver tables: rows that stand for raw property data.

Each definition is one SQL text rendered for Spark or for the checking engine, so both sides start from the same
rows. ``{str}`` is the string type and ``{d}`` the suffix of a double literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodespark.session import spread

DIALECTS = {"spark": {"str": "string", "d": "D"}, "duckdb": {"str": "varchar", "d": "::double"}}

COMPOUNDS = """
select concat(a, case when na = 1 then '' else cast(na as {str}) end,
              b, case when nb = 1 then '' else cast(nb as {str}) end,
              case when l_linenumber % 3 = 0 then 'Ge2' else '' end) as formula,
       case when l_orderkey % 97 = 0 then null else round(l_discount * 20 + l_tax, 6) end as ms
from (select l_orderkey, l_linenumber, l_discount, l_tax,
             case l_partkey % 6 when 0 then 'Fe' when 1 then 'Co' when 2 then 'Mn' when 3 then 'Cr'
                                when 4 then 'Ni' else 'Sm' end as a,
             case l_suppkey % 6 when 0 then 'Al' when 1 then 'Si' when 2 then 'B' when 3 then 'N'
                                when 4 then 'S' else 'Zr' end as b,
             1 + l_partkey % 12 as na, 1 + cast(floor(l_quantity) as int) % 6 as nb
      from lineitem) z
"""

EXPORTS = """
select case when l_orderkey % 89 <> 0 then
         concat(case l_partkey % 7 when 0 then 'Fe' when 1 then 'Co' when 2 then 'Mn' when 3 then 'U'
                                 when 4 then 'Yb' when 5 then 'Y' else 'Ni' end,
              cast(1 + l_partkey % 5 as {str}), 'O', cast(1 + l_suppkey % 4 as {str})) end as composition,
       case when l_orderkey % 61 = 0 then 'n/a' else cast(l_discount as {str}) end
           as total_magnetization_normalized_vol,
       l_returnflag <> 'N' as is_magnetic
from lineitem
"""

# Property documents. One in fifty orders is malformed (a bare leading-dot number), one in 53 has text after the
# document, one line number carries the text none as its formula, one a leaf without wrapper, one a number where an
# array is declared; some name a key in two sections or in the earlier one only, some leaves hold more than a value.
DOCUMENTS = """
select l_orderkey as k, l_linenumber as ln,
       concat('{{"name":"doc","properties":{{"approach":{{"value":"theory"}},"chemistry":{{"chemical formula":',
              case when l_linenumber = 1 then '{{"value":"none"}}' when l_linenumber = 6 then '"Fe7B1"'
                   else concat('{{"value":"Fe', cast(1 + l_partkey % 5 as {str}), 'B1"}}') end,
              case when l_linenumber in (2, 5) then ',"magnetic order":{{"value":"from chemistry"}}' else '' end,
              '}},"crystal":{{"compound space group":{{"value":', cast(1 + l_suppkey % 230 as {str}),
              '}},"lattice parameters":{{"value":',
              case when l_linenumber = 7 then '3' else concat('[', cast(l_quantity as {str}), ',', cast(l_tax as {str}), ']') end,
              '}}}},',
              '"magnetics":{{"saturation magnetization":{{"value":',
              case when l_orderkey % 50 = 0 then '.692' else cast(1 + l_linenumber as {str}) end,
              case when l_linenumber = 5 then '' when l_partkey % 2 = 0 then '}},"magnetic order":{{"value":null'
                   else '}},"magnetic order":{{"value":"FM"' end,
              '}},"magnetocrystalline anisotropy constants":{{"value":',
              case when l_partkey % 3 = 0 then 'null' when l_partkey % 3 = 1 then '[]'
                   else concat('[', cast(l_discount as {str}), ',0]') end,
              '}},"curie temperature":{{"value":',
              case l_suppkey % 4 when 0 then '"None"' when 1 then '"about 700"' else cast(l_quantity as {str}) end,
              case when l_suppkey % 3 = 0 then ',"unit":"K"' else '' end,
              '}}}}}}}}', case when l_orderkey % 53 = 0 then ' trailing' else '' end) as doc
from lineitem
"""

PREDICTIONS = """
select m as model, cast(l_orderkey % 10 as bigint) as fold, l_extendedprice / 50000 as y,
       l_extendedprice / 50000 + (case m when 'a' then 1 else -1 end) * (l_discount - 0.05{d})
           + 0.5{d} * (l_tax - 0.04{d}) as yhat
from (select *, {models} as m from lineitem) mm
"""
_MODELS = {"spark": "explode(array('a', 'b'))", "duckdb": "unnest(['a', 'b'])"}

FIXTURES = {"compounds": COMPOUNDS, "exports": EXPORTS, "documents_json": DOCUMENTS, "predictions": PREDICTIONS}

# Views whose rows are costly to read back: worth spreading a small input for.
HEAVY = {"documents_json"}


def fixture_sql(name: str, dialect: str = "duckdb") -> str:
    """The SQL of a fixture view in one dialect."""
    return FIXTURES[name].format(models=_MODELS[dialect], **DIALECTS[dialect]).strip()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in ``sf_dir``."""
    lineitem = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
    if name in HEAVY:
        lineitem = spread(lineitem)
    text = fixture_sql(name, "spark").replace("{", "{{").replace("}", "}}")
    return spark.sql(text.replace("from lineitem", "from {lineitem}"), lineitem=lineitem)
