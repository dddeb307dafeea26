"""One run of every per-tenant feature over all tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from vitalspan.operators.features import admin_tenure, common_assessments, report_usage
from vitalspan.operators.tenants import tenant_accounts


@dataclass
class TenantTables:
    """Tenant tables, each with a leading ``client`` column."""

    clients: DataFrame
    definitions: DataFrame
    entries: DataFrame
    session_dates: DataFrame
    prebuilts: DataFrame
    access_log: DataFrame
    basic_log: DataFrame
    users: DataFrame
    user_roles: DataFrame
    roles: DataFrame
    responses: DataFrame
    enrolments: DataFrame
    sessions: DataFrame
    assessments: DataFrame


def tenant_features(tables: TenantTables, as_of, responses_above: int = 10) -> dict[str, DataFrame]:
    """Report usage, admin tenure and common assessments, keyed by client.

    Account numbers lose their braces in the first two and keep them in the third.
    """
    t = tables
    bare = tenant_accounts(t.clients, t.definitions, t.entries)
    braced = tenant_accounts(t.clients, t.definitions, t.entries, strip=False)
    return {
        "dna_prebuilt_report_usage": report_usage(bare, t.prebuilts, t.access_log, t.session_dates, as_of),
        "dna_system_admin_tenure": admin_tenure(bare, t.basic_log, t.users, t.user_roles, t.roles, as_of),
        "dna_common_assessments": common_assessments(
            braced,
            t.responses,
            t.enrolments,
            t.sessions,
            t.assessments,
            t.session_dates,
            as_of,
            responses_above=responses_above,
        ),
    }
