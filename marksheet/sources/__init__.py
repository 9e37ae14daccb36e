"""Sources: folders of projects."""
