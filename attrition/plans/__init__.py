"""End-to-end plans: training_table (prep job), bucketed (the same from
bucketed tables), modelling (model job), jobs (CLI), registry (named queries used by the driver contract)."""
