"""Writers of snapshots, hitters, packet logs and alerts."""
