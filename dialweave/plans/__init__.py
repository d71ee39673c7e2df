"""The named reports and listings; each takes the tables by name and returns a DataFrame."""

from dialweave.plans.dashboard import (  # noqa: F401
    active_agents,
    call_status_distribution,
    calls_listing,
    dashboard_kpis,
    employees_by_role,
    project_overview,
    recent_calls,
)
from dialweave.plans.listings import (  # noqa: F401
    customer_detail,
    customer_fences,
    customers_listing,
    customers_matching,
    details,
    employee_detail,
    employees_listing,
    employees_matching,
    project_detail,
    projects_listing,
    projects_matching,
    teams_listing,
    teams_matching,
    user_detail,
    users_listing,
    users_matching,
    write_search_index,
)
from dialweave.plans.performance import (  # noqa: F401
    agent_days,
    agent_performance,
    agent_performance_by_days,
    daily_activity,
    daily_counts,
    project_performance,
    project_stats,
)
from dialweave.plans.staffing import (  # noqa: F401
    available_employees,
    project_customers,
    project_staff,
    team_members_flat,
    team_with_members,
    unassigned_customers,
)
from dialweave.plans.worklists import (  # noqa: F401
    agent_worklist,
    assignment_check,
    assignment_history,
    assignments_listing,
    assignments_matching,
    employee_assignments,
    worklist_matching,
)
