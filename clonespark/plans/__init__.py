"""The catalogue, parameters, and the plan of a whole run."""
