"""DataFrame -> DataFrame building blocks. Those that run a job to build their frame say so."""

from dialweave.operators.aggregates import (  # noqa: F401
    conditional_counts,
    count_children,
    grouped_count,
    tall_counts,
    zero_fill,
)
from dialweave.operators.fences import fenced_page, fences  # noqa: F401
from dialweave.operators.filters import (  # noqa: F401
    lookup,
    match_either,
    not_in,
    owned_by,
    text_search,
    time_range,
    where_equal,
)
from dialweave.operators.joins import attach, fan_out, having, lacking  # noqa: F401
from dialweave.operators.ordering import (  # noqa: F401
    Order,
    by_name,
    fetch_page,
    newest,
    order_columns,
    page_info,
    paginate,
    priority_order,
    priority_sort,
    sort_rows,
)
from dialweave.operators.postings import indexed_search, read_postings, write_postings  # noqa: F401
from dialweave.operators.shaping import display_defaults, nest, preview, rename, unnest  # noqa: F401
