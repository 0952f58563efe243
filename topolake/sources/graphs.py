"""Warehouse schema graphs: the tables that the given star makes, and published and synthetic schemas as data.

Edges are stored in data-flow direction: fk_to from child to parent, derived_from from source to target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sales
from .storage import written

SALES = "sales"  # the dataset that the given star makes
NODE_SCHEMA = "dataset string, node_id int, name string"
EDGE_SCHEMA = "dataset string, src string, dst string, edge_type string"
DIM_SCHEMA = "name string, silo string, layer string, ordinal int"

# Tables of each published schema, in order, and their references (child: parents).
TPC_DS_TABLES = """
store_sales store_returns catalog_sales catalog_returns web_sales web_returns inventory
date_dim time_dim item customer customer_address customer_demographics household_demographics store promotion
warehouse ship_mode reason income_band call_center catalog_page web_site web_page
"""
TPC_DS_FK = """
store_sales: date_dim time_dim item customer customer_demographics household_demographics customer_address store promotion
store_returns: date_dim time_dim item customer customer_demographics household_demographics customer_address store reason
catalog_sales: date_dim time_dim item customer customer_demographics household_demographics customer_address call_center catalog_page ship_mode warehouse promotion
catalog_returns: date_dim time_dim item customer customer_demographics household_demographics customer_address reason call_center catalog_page ship_mode warehouse
web_sales: date_dim time_dim item customer customer_demographics household_demographics customer_address web_site web_page ship_mode warehouse promotion
web_returns: date_dim time_dim item customer customer_demographics household_demographics customer_address reason web_page
inventory: date_dim item warehouse
customer: customer_address customer_demographics household_demographics
household_demographics: income_band
"""
TPC_DI_TABLES = """
DimBroker DimCustomer DimAccount DimCompany DimDate DimSecurity DimTime DimTrade
FactCashBalances FactHoldings FactMarketHistory FactWatches Financial Industry StatusType TaxRate TradeType
"""
TPC_DI_FK = """
DimAccount: DimBroker DimCustomer
DimSecurity: DimCompany
DimTrade: DimBroker DimDate DimTime DimDate DimTime DimSecurity DimCompany DimCustomer DimAccount
FactCashBalances: DimCustomer DimAccount DimDate
FactHoldings: DimCustomer DimAccount DimSecurity DimCompany DimDate DimTime
FactMarketHistory: DimSecurity DimCompany DimDate
FactWatches: DimCustomer DimSecurity DimDate DimDate
Financial: DimCompany
Prospect: DimDate
"""
TPC_DI_LINEAGE = """
SRC.CustomerMgmt: DimCustomer DimAccount
SRC.HR: DimBroker
SRC.FINWIRE_CMP: DimCompany
SRC.FINWIRE_SEC: DimSecurity
SRC.FINWIRE_FIN: Financial
SRC.Date: DimDate
SRC.Time: DimTime
SRC.Trade: DimTrade FactHoldings
SRC.TradeHistory: DimTrade
SRC.HoldingHistory: FactHoldings
SRC.CashTransaction: FactCashBalances
SRC.DailyMarket: FactMarketHistory
SRC.WatchHistory: FactWatches
SRC.Prospect: Prospect
SRC.StatusType: StatusType
SRC.TaxRate: TaxRate
SRC.TradeType: TradeType
SRC.Industry: Industry
DimCustomer: Prospect
DimCompany: DimSecurity
TaxRate: DimCustomer
"""
OMOP_TABLES = """
person observation_period visit_occurrence visit_detail condition_occurrence drug_exposure procedure_occurrence
device_exposure measurement observation death note note_nlp specimen fact_relationship episode episode_event
location care_site provider payer_plan_period cost drug_era dose_era condition_era
concept vocabulary domain concept_class concept_relationship relationship concept_synonym concept_ancestor
source_to_concept_map drug_strength cdm_source metadata
"""
OMOP_FK = """
person: location provider care_site concept
visit_occurrence: person care_site provider concept
visit_detail: visit_occurrence person care_site provider
condition_occurrence: person visit_occurrence provider concept
drug_exposure: person visit_occurrence provider concept
procedure_occurrence: person visit_occurrence provider concept
device_exposure: person visit_occurrence provider concept
measurement: person visit_occurrence provider concept
observation: person visit_occurrence provider concept
death: person concept
note: person visit_occurrence provider concept
note_nlp: note concept
specimen: person concept
episode: person concept
episode_event: episode
observation_period: person
care_site: location concept
provider: care_site concept
payer_plan_period: person concept
cost: concept
drug_era: person concept
dose_era: person concept
condition_era: person concept
concept: vocabulary domain concept_class
concept_relationship: concept relationship
concept_ancestor: concept
concept_synonym: concept
source_to_concept_map: concept vocabulary
drug_strength: concept
fact_relationship: concept
"""
OMOP_LINEAGE = """
drug_exposure: drug_era dose_era
condition_occurrence: condition_era
note: note_nlp
episode: episode_event
concept: condition_occurrence drug_exposure procedure_occurrence measurement observation device_exposure visit_occurrence death specimen episode
source_to_concept_map: person condition_occurrence drug_exposure procedure_occurrence measurement observation
"""
# Silo / layer: tables of the layered schema, and its edges between silos.
SYN_TABLES = """
logistics/raw: raw_purchase_orders raw_shipment_tracking raw_supplier_catalog raw_warehouse_inventory raw_freight_invoices
logistics/staging: stg_orders_cleaned stg_shipments_validated stg_suppliers_deduped stg_inventory_snapshot stg_freight_reconciled
logistics/core: dim_supplier dim_product dim_warehouse dim_carrier fact_shipment fact_purchase_order
logistics/mart: mart_delivery_performance mart_procurement_cost mart_supplier_scorecard mart_inventory_turnover
hr/raw: raw_employee_records raw_department_hierarchy raw_compensation_data
hr/staging: stg_employees_cleaned stg_departments_mapped stg_compensation_normalized
hr/core: dim_employee dim_department fact_payroll
hr/mart: mart_headcount_report mart_attrition_analysis
healthcare/raw: raw_patient_intake raw_lab_results raw_prescriptions
healthcare/staging: stg_patients_validated stg_labs_standardized stg_prescriptions_coded
healthcare/core: dim_patient dim_provider fact_encounter
healthcare/mart: mart_readmission_risk mart_treatment_outcomes
ecommerce/raw: raw_cart_sessions raw_product_catalog raw_payment_events
ecommerce/staging: stg_sessions_enriched stg_products_normalized stg_payments_validated
ecommerce/core: dim_customer dim_product_listing fact_transaction
ecommerce/mart: mart_conversion_funnel mart_revenue_dashboard
finance/raw: raw_ledger_entries raw_bank_feeds raw_tax_filings
finance/staging: stg_ledger_reconciled stg_bank_matched stg_tax_validated
finance/core: dim_account dim_cost_center fact_journal_entry
finance/mart: mart_trial_balance mart_cash_flow_statement
"""
SYN_CROSS = """
stg_employees_cleaned: stg_shipments_validated
dim_carrier: stg_ledger_reconciled
dim_account: stg_compensation_normalized
stg_payments_validated: stg_freight_reconciled
"""
# The driver's tables and their key references.
STAR_TABLES = """
region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations
"""
STAR_FK = """
nation: region
customer: nation
supplier: nation
orders: customer
lineitem: orders part supplier
events: customer
labels: documents
"""


def listed(text: str) -> list[tuple[str, str]]:
    """(left, right) of each `left: right right` line, repeats and order kept."""
    rows = (line.partition(": ") for line in text.strip().splitlines())
    return [(left, right) for left, _, rest in rows for right in rest.split()]


def table_dim() -> list[tuple[str, str, str, int]]:
    """(name, silo, layer, ordinal within silo and layer) of the layered schema."""
    out = []
    for line in SYN_TABLES.strip().splitlines():
        place, _, names = line.partition(": ")
        silo, layer = place.split("/")
        out += [(n, silo, layer, i) for i, n in enumerate(names.split())]
    return out


def _layered_lineage() -> list[tuple[str, str]]:
    """Each table of a layer derives from the same and the next place, modulo its size, of the layer before; a silo's
    first staging table from one raw table only."""
    by: dict[tuple[str, str], list[str]] = {}
    for name, silo, layer, _ in table_dim():
        by.setdefault((silo, layer), []).append(name)
    edges = []
    for silo in dict.fromkeys(s for s, _ in by):
        for before, after in (("raw", "staging"), ("staging", "core"), ("core", "mart")):
            feeders = by[silo, before]
            for i, name in enumerate(by[silo, after]):
                steps = 1 if after == "staging" and i == 0 else 2
                edges += [(f, name) for f in dict.fromkeys(feeders[(i + s) % len(feeders)] for s in range(steps))]
    return edges


def _layered_references() -> list[tuple[str, str]]:
    core = [r for r in table_dim() if r[2] == "core"]
    return [(f, d) for f, silo, _, _ in core if f.startswith("fact_") for d, other, _, _ in core if other == silo and d.startswith("dim_")]


def graphs() -> tuple[list[tuple], list[tuple]]:
    """(nodes, edges) of all fixtures; edges with an end outside the dataset's tables are left out."""
    syn = [r[0] for r in table_dim()]
    sources = sorted({s for s, _ in listed(TPC_DI_LINEAGE) if s.startswith("SRC.")})
    found = {
        "star": (STAR_TABLES.split(), listed(STAR_FK), []),
        "tpc_ds": (TPC_DS_TABLES.split(), listed(TPC_DS_FK), []),
        "tpc_di": (TPC_DI_TABLES.split() + sources, listed(TPC_DI_FK), listed(TPC_DI_LINEAGE)),
        "omop_cdm": (OMOP_TABLES.split(), listed(OMOP_FK), listed(OMOP_LINEAGE)),
        "syn_logistics": (syn, _layered_references(), _layered_lineage()),
        "syn_cross": (syn, _layered_references(), _layered_lineage() + listed(SYN_CROSS)),
    }
    nodes, edges = [], []
    for name, (tables, fk, lineage) in found.items():
        nodes += [(name, i, t) for i, t in enumerate(tables)]
        known = set(tables)
        edges += [(name, a, b, kind) for kind, pairs in (("fk_to", fk), ("derived_from", lineage)) for a, b in pairs if a in known and b in known]
    return nodes, edges


def published(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The published schemas as (nodes, edges): local relations of fixed size."""
    nodes, edges = graphs()
    return spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA)


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the published schemas and, as dataset `sales`, of the tables that the given star makes.

    The latter's edges are drawn from all order lines and written once; numbers of its tables follow their names.
    """
    nodes, edges = published(spark)
    drawn = written(sales.table_edges(spark, sf_dir), "sales-edges").select(F.lit(SALES).alias("dataset"), "src", "dst", "edge_type")
    # A catalogue: seven tables a region.
    place = (F.row_number().over(Window.orderBy("name")) - 1).cast(nodes.schema["node_id"].dataType)
    own = sales.tables(spark, sf_dir).select(F.lit(SALES).alias("dataset"), place.alias("node_id"), "name")
    return nodes.unionByName(own), edges.unionByName(drawn)


def load_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, silo, layer, ordinal) of the tables that the given star makes."""
    return sales.tables(spark, sf_dir)


def published_dim(spark: SparkSession) -> DataFrame:
    """The same of the layered schema that is published."""
    return spark.createDataFrame(table_dim(), DIM_SCHEMA)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def sql_with(*more: str) -> str:
    """WITH clause of nodes, edges and dim for SQL on the same tables, then further named queries."""
    nodes, edges = graphs()
    return (
        f"WITH RECURSIVE {sales.PLACES_SQL},\n{sales.TABLES_SQL},\n{sales.EDGES_SQL},\n"
        f"nodes(dataset, node_id, name) AS MATERIALIZED (SELECT * FROM (VALUES {_values(nodes)}) UNION ALL SELECT '{SALES}', CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER), name FROM sales_tables),\n"
        f"edges(dataset, src, dst, edge_type) AS MATERIALIZED (SELECT * FROM (VALUES {_values(edges)}) UNION ALL SELECT '{SALES}', src, dst, edge_type FROM sales_edges),\n"
        f"dim(name, silo, layer, ordinal) AS (SELECT name, silo, layer, ordinal FROM sales_tables)" + "".join(f",\n{m}" for m in more) + "\n"
    )
