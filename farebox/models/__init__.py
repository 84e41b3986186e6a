"""Random forests for the time and the route of the next purchase."""
