"""The metrics of a bank: filed figures in dollars and percent, and what is computed from them.

Fields come as filed (thousands, year to date); a metric is in dollars, and flows are
brought to a year by the quarter. Computed metrics are expressions over the fields and
over market and filing figures of the same row; trends and alerts come joined by the names
of :mod:`ledgerline.operators.timelines`. One projection makes all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from .registry import Metric, project

# Metric, field as filed, and the direction that is better, by group.
FILED = """
roaa ROA higher
nim NIMY higher
efficiency_ratio EEFFR lower
npl_ratio NCLNLSR lower
nco_ratio NTLNLSR lower
allowance_loans ELNANTR -
cet1_ratio IDT1CER higher
total_capital_ratio RBCRWAJ higher
leverage_ratio RBCT1JR higher
total_assets ASSET -
total_loans LNLSNET -
total_loans_gross LNLSGR -
securities SC -
cash_balances CHBAL -
fed_funds_sold FREPO -
total_liab LIAB -
total_equity EQTOT -
intangibles INTAN -
ore ORE -
trading_assets TRADE -
ln_re_total LNRE -
ln_re_residential LNRERES -
ln_re_nres_oo LNRENROW -
ln_re_nres_noo LNRENROT -
ln_re_nres LNRENRES -
ln_re_multifam LNREMULT -
ln_re_construct LNRECONS -
ln_re_ag LNREAG -
ln_ci LNCI -
ln_consumer LNCON -
ln_auto LNAUTO -
ln_credit_card LNCRCD -
ln_ag LNAG -
total_deposits DEP -
core_deposits COREDEP -
insured_deposits DEPINS -
uninsured_deposits DEPUNINS -
brokered_deposits BRO -
demand_deposits DDT -
mmda_savings NTRSMMDA -
large_time_dep DEPLGAMT -
dep_lt_250k DEPSMAMT -
int_bearing_dep DEPIDOM -
nonint_dep DEPNIDOM -
sec_afs SCAF -
sec_htm SCHA -
sec_ust SCUST -
sec_agency SCAGE -
sec_uso SCUSO -
sec_muni SCMUNI -
sec_abs SCABS -
sec_unreal_gl IGLSEC higher
sec_htm_unreal SCSNHAA -
loans_to_deposits LNLSDEPR -
loans_to_assets LNLSNTV -
deposits_to_assets DEPDASTR -
earning_assets_pct ERNASTR higher
equity_to_assets EQV higher
npl_cre NCRER lower
npl_resi NCRECONR lower
npl_multifam NCREMULR lower
npl_nres_re NCRENRER lower
npl_ci IDNCCIR lower
npl_consumer IDNCCONR lower
nco_re NTRER lower
nco_ci NTCOMRER lower
past_due_30_89 P3LNLS -
past_due_90 P9LNLS -
reserve_coverage IDERNCVR higher
reserve_to_loans LNATRESR -
nco_to_reserve IDLNCORR lower
reserve_nco_coverage LNRESNCR higher
net_income NETINC -
int_income INTINC -
int_expense EINTEXP -
net_interest_income NIM -
nonint_income NONII -
nonint_expense NONIX -
provision ELNATR -
pretax_income PTAXNETINC -
taxes ITAX -
int_income_yield INTINCY higher
int_expense_yield INTEXPY lower
nonint_inc_assets NONIIAY higher
nonint_exp_assets NONIXAY lower
pretax_roa ROAPTX higher
employees NUMEMP -
assets_per_employee ASTEMPM higher
branches OFFDOM -
provision_to_assets ELNATRY lower
net_op_income_assets NOIJY higher
"""
# Fields in thousands, and flows that are filed year to date.
THOUSANDS = """
ASSET DEP LNLSNET LNLSGR SC CHBAL EQTOT INTAN ORE COREDEP DEPINS DEPUNINS DEPDOM DEPNIDOM DEPIDOM DEPLGAMT DEPSMAMT NETINC NIM NONII
NONIX LIAB FREPO TRADE LNRE LNRERES LNRENRES LNRENROW LNRENROT LNREMULT LNRECONS LNREAG LNCI LNCON LNAUTO LNCRCD LNAG BRO DDT NTRSMMDA
SCAF SCHA SCUST SCAGE SCUSO SCMUNI SCABS IGLSEC SCSNHAA P3LNLS P9LNLS INTINC EINTEXP ELNATR PTAXNETINC ITAX
""".split()
YEAR_TO_DATE = "NETINC INTINC EINTEXP NIM NONII NONIX ELNATR PTAXNETINC ITAX".split()

GROSS = "coalesce(nullif(LNLSGR, 0), LNLSNET)"


def _share(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then {part} / {whole} * 100 end"


def computed(coe: float = 10.0, growth: float = 4.0) -> dict[str, tuple[str, str]]:
    """Metrics that are expressions over the row, with the direction that is better; in order, later ones over earlier ones' fields only."""
    tangible = "(EQTOT - coalesce(INTAN, 0))"
    roatce = f"(case when {tangible} > 0 then NETINC * 4e0 / quarter / {tangible} * 100 end)"
    blended = f"coalesce(roatce_holdco, 0.75e0 * {roatce} + 0.25e0 * roatce_4q, {roatce}, roatce_4q)"
    fair = f"(case when ({blended} - {growth}e0) / ({coe - growth}e0) > 0 then ({blended} - {growth}e0) / ({coe - growth}e0) end)"
    liabilities = "(case when DEPIDOM > 0 then DEPIDOM + coalesce(FREPO, 0) + coalesce(OTHBFHLB, 0) + coalesce(SUBND, 0) end)"
    return {
        "change_pct": ("case when prev_close > 0 then (price / prev_close - 1) * 100 end", "higher"),
        "market_cap": ("price * shares_outstanding", "-"),
        "pe_ratio": ("case when eps > 0 then price / eps end", "lower"),
        "ptbv_ratio": ("case when tbvps > 0 then price / tbvps end", "lower"),
        "pb_ratio": ("case when bvps > 0 then price / bvps end", "lower"),
        "dividend_yield": ("case when price > 0 then dps / price * 100 end", "higher"),
        "roatce": (roatce, "higher"),
        "roatce_blended": (blended, "higher"),
        "fair_ptbv": (fair, "-"),
        "fair_price": (f"{fair} * tbvps", "-"),
        "ptbv_discount": (f"case when price > 0 then ({fair} * tbvps - price) / price * 100 end", "higher"),
        "ln_re_pct": (_share("LNRE", GROSS), "-"),
        "ln_cre_pct": (_share("LNRENRES", GROSS), "-"),
        "ln_resi_pct": (_share("LNRERES", GROSS), "-"),
        "ln_multifam_pct": (_share("LNREMULT", GROSS), "-"),
        "ln_construct_pct": (_share("LNRECONS", GROSS), "-"),
        "ln_ci_pct": (_share("LNCI", GROSS), "-"),
        "ln_consumer_pct": (_share("LNCON", GROSS), "-"),
        "cre_to_capital": (_share("LNRENRES", "EQTOT"), "lower"),
        "uninsured_pct": ("DEPUNINS / nullif(DEP, 0) * 100", "lower"),
        "core_dep_pct": ("COREDEP / nullif(DEP, 0) * 100", "higher"),
        "brokered_pct": ("BRO / nullif(DEP, 0) * 100", "lower"),
        "nonint_dep_pct": ("DEPNIDOM / nullif(DEP, 0) * 100", "higher"),
        "sec_to_assets_pct": (_share("SC", "ASSET"), "-"),
        "htm_pct": (_share("SCHA", "SC"), "-"),
        "nim_spread": ("INTINCY - INTEXPY", "higher"),
        "nonint_burden": ("NONIXAY - NONIIAY", "lower"),
        "cost_of_funds": (f"coalesce(INTEXPY, EINTEXP * 4e0 / quarter / {liabilities} * 100)", "lower"),
    }


#: Metrics that come joined under their own name: market and filing figures, averages over quarters, trends and counts of alerts.
JOINED = {
    "price": "-", "volume": "-", "eps": "higher", "tbvps": "-", "tbvps_source": "-", "bvps": "-", "bvps_source": "-", "roatce_normalized": "higher", "earnings_distorted": "-", "roaa_4q": "higher", "roatce_4q": "higher",
    "roatce_holdco": "higher", "nim_4q": "higher", "efficiency_release": "lower", "cet1_current": "higher", "cet1_qoq_pp": "higher", "tbv_cagr_1y": "higher", "payout_ratio_4q": "lower", "buyback_capacity_usd": "higher",
    "capital_alerts_count": "lower", "shareholder_yield": "higher", "dividend_yield_sec": "higher", "buyback_yield": "higher", "payout_ratio_ttm": "-", "total_return_ratio_ttm": "higher", "share_change_pct_ttm": "lower",
    "dps_yoy_pct": "higher", "dividends_ttm": "-", "buybacks_ttm": "-", "nco_4q_trend_bps": "lower", "npl_trend_bps": "lower", "pd_migration_bps": "lower", "reserve_coverage_pct": "higher", "worst_segment_npl": "lower",
    "credit_alerts_count": "lower", "deposit_cycle_beta": "lower", "deposit_rolling_beta": "lower", "dep_qoq_growth": "higher", "cod_qoq_bps": "lower", "deposit_alerts_count": "lower",
}


def filed() -> list[Metric]:
    """The filed metrics, in dollars and yearly flows."""
    rows = [line.split() for line in FILED.strip().splitlines()]
    return [Metric(key, field, thousands=field in THOUSANDS, ytd=field in YEAR_TO_DATE, better=better) for key, field, better in rows]


def directions() -> dict[str, str]:
    """Every metric's better direction: higher, lower or -."""
    return {m.key: m.better for m in filed()} | {k: d for k, (_, d) in computed().items()} | JOINED


def fields() -> list[str]:
    """The call-report fields that the metrics read."""
    return sorted({m.source for m in filed()} | {"OTHBFHLB", "SUBND"})


def bank_metrics(df: DataFrame, keys: list[str], quarter: Column, coe: float = 10.0, growth: float = 4.0) -> DataFrame:
    """All metrics of each row. ``df`` has the fields, ``quarter`` (1 to 4), price, prev_close, shares_outstanding, eps, bvps, tbvps, dps, roatce_4q and roatce_holdco; joined metrics it lacks are left out."""
    given = [Metric(k, k, better=d) for k, d in JOINED.items() if k in df.columns and not k.endswith("_source")]
    own = [Metric(k, e, better=d) for k, (e, d) in computed(coe, growth).items()]
    return project(df, [*filed(), *own, *given], [*keys, *(k for k in JOINED if k.endswith("_source") and k in df.columns)], quarter)
