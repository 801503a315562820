"""attrition — subscription-churn feature and modelling engine on Spark.

Layout
------
sources/    table reads and writes (S1-S5) and role views over the test tables
functions/  column expressions (date arithmetic, labels, safe ratios)
operators/  DataFrame -> DataFrame building blocks (spine, features, ranking,
            split/balance, encoding, models, evaluation, statistics)
plans/      end-to-end jobs: sources -> training table, training table -> reports
llm/        training-data operators; nothing else imports it
"""

from attrition.config import ChurnConfig

__all__ = ["ChurnConfig"]
