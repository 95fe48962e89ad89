"""Questions over the stored flow_metrics and heavy_hitters tables."""
