"""Price-like time series and news text as Spark plans over many series at once."""

from seriesengine import schemas
from seriesengine.functions.columns import (
    day_name, day_of_week, lenient_time, millis_time, nan_to_null, ratio, row_mean,
    sentiment_class, strict_time,
)
from seriesengine.operators.aggregates import (
    daily_average, last_known, regression_metrics, sentiment_distribution, weekday_change,
)
from seriesengine.operators.autoregression import fit_autoregression
from seriesengine.operators.chunks import ChunkPlan, over_rows, plan_chunks
from seriesengine.operators.decompose import seasonal_decompose
from seriesengine.operators.features import (
    chart_overlay, lag_features, market_features, ohlc_features, sentiment_over_time,
    trailing_range,
)
from seriesengine.operators.forecast import (
    fit_ols_forecast, fit_sequence_forecast, forecast_deltas, future_frame, market_model_metrics,
    ols_forecast, recursive_forecast, sequence_forecast, tail_windows,
)
from seriesengine.operators.order import (
    global_positions, order_violations, sorted_ranges, write_sorted,
)
from seriesengine.operators.quality import (
    duplicate_times, quality_report, require_columns, require_unique_times,
)
from seriesengine.operators.regression import fit_ols, gram_matrix, predict_linear
from seriesengine.operators.rolling import (
    diff, forward_fill, lag, moving_averages, pct_change, rolling_mean, rolling_std,
)
from seriesengine.operators.scaling import apply_minmax, fit_minmax, invert_minmax
from seriesengine.operators.sequences import (
    chrono_split, hash_split, sequence_frame, sequences, series_tail,
)
from seriesengine.session import configure, materialize
from seriesengine.sources.files import latest_articles, read_series, write_series
from seriesengine.sources.ingest import (
    due_for_ingest, keep_first, merge_keep_first, new_rows, record_ingest,
)
from seriesengine.sources.pipeline import ingest
from seriesengine.sources.tables import (
    ConcurrentWrite, append_table, day_cell, drop_unused, files_for, hash_cell, merge_table,
    read_table, replace_table, table_files, table_version,
)
from seriesengine.sources.payloads import parse_market_json, parse_news_json, parse_ohlc_json
from seriesengine.streaming.streams import (
    bar_parts, daily_average_parts, merged_bars, merged_daily_average, read_landed, read_rolling,
    start_merge, start_parts, start_rolling, start_table, stream_bars, stream_daily_average,
    stream_dedup,
)
from seriesengine.text.sentiment import (
    default_modifiers, lexicon_sentiment, read_lexicon, score_articles, tokens,
)
from seriesengine.text.terms import bigram_llr, term_counts, term_frequency, word_cloud
