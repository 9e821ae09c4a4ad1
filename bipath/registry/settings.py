"""Parameters of the registered queries, which their SQL shares."""

SEED = 42
DRUG = "D1"
# Model settings of the queries; the step size suits scaled cells.
ALS_GRID = {"regParam": [0.01, 0.1], "rank": [10], "alpha": [10.0], "maxIter": [5]}
FM_GRID = {"regParam": [0.0, 0.001], "maxIter": [8], "initStd": [0.1], "factorSize": [2]}
FM_STEP = 0.01
FEEDBACK_GRID = {"regParam": [0.001, 0.01], "maxIter": [500], "initStd": [0.001], "factorSize": [2]}
FEEDBACK_STEP = 0.0001
FOLDS = 5
# The reference's whole training (config.json, ALSModel.train): 500 FM steps; rank 30 and ten ALS iterations.
WHOLE_ALS_GRID = {**ALS_GRID, "rank": [30], "maxIter": [10]}
WHOLE_FM_GRID = {**FM_GRID, "maxIter": [500]}
